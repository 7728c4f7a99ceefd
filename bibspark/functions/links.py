"""Full-text links of records, and predicates on pages and responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import doi_url
from .text import first, has, text

#: What the head of a login page holds, lower case. The institution's own hosts are parameters.
LOGIN = ("<title>authentication required</title>", "<title>login</title>", "cas – central authentication service", 'id="username"')


def target(link: Column) -> Column:
    """The URL in a delimited link, else the link itself."""
    url = F.regexp_extract(text(link), r"\$\$U(https?://[^$]+)", 1)
    return F.when(url == "", link).otherwise(url)


def _targets(links: Column) -> Column:
    return F.filter(F.transform(F.coalesce(links, F.array().cast("array<string>")), target), lambda x: F.coalesce(x, F.lit("")) != "")


def bundle(r) -> Column:
    """All full-text links of a record; r gives its columns by name."""
    return F.struct(
        _targets(r("linktohtml")).alias("html_links"),
        _targets(r("linktopdf")).alias("pdf_links"),
        _targets(r("linktorsrc")).alias("source_links"),
        F.nullif(doi_url(first(r("doi"))), F.lit("")).alias("doi_url"),
        (has(r("openaccess")) | has(r("openurl"))).alias("open_access"),
    )


def in_priority(links: Column) -> Column:
    """All URLs of a bundle, each once: PDFs, the DOI, sources, pages."""
    doi = F.when(links["doi_url"].isNotNull(), F.array(links["doi_url"])).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(links["pdf_links"], doi, links["source_links"], links["html_links"]))


def best(links: Column) -> Column:
    return F.get(in_priority(links), F.lit(0))


def login_page(html: Column, hosts: tuple[str, ...] = ()) -> Column:
    """Whether the first 2048 bytes look like a login form."""
    # bytes cut anywhere: a cast, unlike decode, takes a character that the cut divides as it is
    head = F.lower(F.substring(text(html).cast("binary"), 1, 2048).cast("string"))
    out = F.lit(False)
    for s in (*LOGIN, *hosts):
        out = out | head.contains(s)
    return out


#: Texts of links to PDFs, and classes of containers in which a text that names a PDF is enough.
PDF_TEXTS = ("download pdf", "full text (pdf)", "view pdf")
PDF_CONTAINERS = ("download", "fulltext", "access")


def anchors(html: Column) -> Column:
    """The links of a page in order: href, text (markup taken out, lower case), and whether the link or an element around it
    has a class of PDF_CONTAINERS. A container goes up to the first end tag of its name; equal links count alike."""
    page = text(html)
    found = F.regexp_extract_all(page, F.lit(r"""(?is)(<a\s[^>]*?href\s*=\s*["'][^"']*["'][^>]*>.*?(?:</a\s*>|\z))"""), F.lit(1))
    classed = rf"""(?is)<([a-z][a-z0-9]*)\s[^>]*?class\s*=\s*["'](?:[^"']*\s)?(?:{"|".join(PDF_CONTAINERS)})(?:\s[^"']*)?["'][^>]*>"""

    def link(a: Column) -> Column:
        return F.struct(
            F.regexp_extract(a, r"""(?is)^<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", 1).alias("href"),
            F.lower(F.regexp_replace(F.regexp_replace(a, r"(?is)^<a\s[^>]*>|</a\s*>$", ""), r"<[^>]*>", "")).alias("text"),
            a.rlike(classed.replace("<([a-z][a-z0-9]*)", "^<(a)")).alias("own"),
        )

    # pieces of the page from one opening of such a container to its end: up to the first end tag of its name
    inside = F.when(page.rlike(classed), F.regexp_extract_all(page, F.lit(rf"(?is)({classed[5:]}.*?(?:</\2\s*>|\z))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    held = F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit(r"""(?is)(<a\s[^>]*?href\s*=\s*["'][^"']*["'][^>]*>.*?(?:</a\s*>|\z))"""), F.lit(1))))
    return F.transform(found, lambda a: F.struct(link(a)["href"].alias("href"), link(a)["text"].alias("text"), (link(a)["own"] | F.array_contains(held, a)).alias("in_container")))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(text(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def pdf_link(href: Column, link_text: Column | None = None, in_container: Column | None = None) -> Column:
    """Whether a link leads to a PDF, by its address, its text, or a text that names a PDF in a container for downloads."""
    h = F.lower(text(href))
    out = h.endswith(".pdf") | h.contains("/pdf/") | h.contains("format=pdf") | h.contains("type=pdf")
    if link_text is not None:
        t = F.lower(text(link_text))
        for s in PDF_TEXTS:
            out = out | t.contains(s)
        if in_container is not None:
            out = out | (t.contains("pdf") & in_container)
    return out


def pdf_links(html: Column) -> Column:
    """The addresses of a page's links to PDFs."""
    return F.transform(F.filter(anchors(html), lambda a: pdf_link(a["href"], a["text"], a["in_container"])), lambda a: a["href"])


def pdf_response(content_type: Column, url: Column, status: Column) -> Column:
    pdf = F.lower(text(content_type)).contains("application/pdf") | F.lower(text(url)).endswith(".pdf")
    return pdf & (status >= 200) & (status < 400)


def cookie_class(name: Column) -> Column:
    return F.when(F.lower(name).contains("proxy"), "proxy").when(name.startswith("__Secure-") | name.startswith("__Host-"), "secure").otherwise("other")
