"""Standard numbers, DOIs, hosts, URLs and content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

#: Prefixes of a DOI.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:")


def bare(number: Column) -> Column:
    """Without hyphens and spaces."""
    return F.translate(text(number), "- ", "")


def _weighted(number: Column, weights: list[int]) -> Column:
    """The sum of weighted digits; X counts 10."""
    total = F.lit(0)
    for i, w in enumerate(weights):
        c = F.upper(F.substring(number, i + 1, 1))
        total = total + w * F.when(c == "X", 10).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))
    return total


def isbn10_ok(number: Column) -> Column:
    return number.rlike(r"^[0-9]{9}[0-9Xx]$") & (_weighted(number, list(range(10, 0, -1))) % 11 == 0)


def isbn13_ok(number: Column) -> Column:
    return number.rlike(r"^[0-9]{13}$") & (_weighted(number, [1, 3] * 6 + [1]) % 10 == 0)


def isbn_ok(number: Column) -> Column:
    n = bare(number)
    return F.when(F.length(n) == 10, isbn10_ok(n)).when(F.length(n) == 13, isbn13_ok(n)).otherwise(F.lit(False))


def issn_ok(number: Column) -> Column:
    n = bare(number)
    rest = _weighted(n, list(range(8, 1, -1))) % 11
    wanted = F.when(rest == 0, 0).otherwise(11 - rest)
    last = F.when(F.upper(F.substring(n, 8, 1)) == "X", 10).otherwise(F.substring(n, 8, 1).try_cast("int"))
    return F.coalesce(n.rlike(r"^[0-9]{7}[0-9Xx]$") & (wanted == last), F.lit(False))


def doi_key(doi: Column) -> Column:
    """A DOI to compare by: trimmed, lower case, its prefixes taken off one after another."""
    out = F.lower(F.trim(text(doi)))
    for p in DOI_PREFIXES:
        out = F.when(out.startswith(p), F.substring(out, F.lit(len(p) + 1), F.length(out))).otherwise(out)
    return out


def doi_bare(doi: Column) -> Column:
    """A DOI without its URL prefix, case kept."""
    return F.regexp_replace(text(doi), r"^https?://doi\.org/", "")


def doi_url(doi: Column) -> Column:
    doi = text(doi)
    return F.when(doi == "", "").when(doi.startswith("http"), doi).otherwise(F.concat(F.lit("https://doi.org/"), doi))


def doi_of_record(doi: Column, links: Column) -> Column:
    """The first DOI; else the one in the first link that holds any, up to a question mark."""
    found = F.get(F.filter(links, lambda x: x.contains("doi.org/")), F.lit(0))
    from_link = F.regexp_extract(F.coalesce(found, F.lit("")), r"doi\.org/([^?]*)", 1)
    return doi_key(F.coalesce(F.nullif(text(F.get(doi, F.lit(0))), F.lit("")), from_link))


def host(url: Column) -> Column:
    """The lower-cased host of a URL, '' without one."""
    return F.lower(F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain(url: Column, proxy: str | None = None) -> Column:
    """The last two labels of the host; `unknown` without a host. proxy: a base whose rewritten hosts are undone first."""
    h = host(url) if proxy is None else unproxied(host(url), proxy)
    labels = F.split(h, r"\.")
    return F.when(h == "", "unknown").when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(h)


def proxied(url: Column, base: str) -> Column:
    """The URL with its host rewritten under the proxy's: dots to hyphens."""
    h = host(url)
    new = F.concat(F.replace(h, F.lit("."), F.lit("-")), F.lit(f".{base}"))
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    tail = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    return F.when((h == "") | h.contains(base), url).otherwise(F.concat(head, new, tail))


def unproxied(host_name: Column, base: str) -> Column:
    """The host before the rewrite; real hyphens become dots."""
    own = F.substring(host_name, F.lit(1), F.length(host_name) - len(base) - 1)
    return F.when(host_name.endswith(f".{base}"), F.replace(own, F.lit("-"), F.lit("."))).otherwise(host_name)


def is_pdf(content: Column) -> Column:
    """Whether binary content starts as a PDF does."""
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def content_key(content: Column, twice: bool = False) -> Column:
    """The first 16 hex digits of SHA-256; for URL downloads of the digest's digest."""
    digest = F.sha2(content.cast("binary"), 256)
    return F.substring(F.sha2(F.substring(digest, 1, 16).cast("binary"), 256) if twice else digest, 1, 16)


def token_payload(token: Column, schema: str) -> Column:
    """The claims of a three-part token, not verified."""
    parts = F.split(token, r"\.")
    body = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(F.size(parts) == 3, F.from_json(F.unbase64(padded).cast("string"), schema))


def token_valid(expires: Column, now: Column, buffer: int = 60) -> Column:
    """valid, and refresh where less than twice the buffer is left."""
    return F.struct((now < expires - buffer).alias("valid"), (expires - now < 2 * buffer).alias("refresh"))


def time_left(seconds: Column) -> Column:
    """Hours and minutes."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m"))
