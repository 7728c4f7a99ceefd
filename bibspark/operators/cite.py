"""Citations in five styles, as Column expressions over metadata rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import doi_url
from ..functions.people import initialled
from ..functions.text import filled, plain, text
from .metadata import page_range

STYLES = ("apa", "mla", "chicago", "bibtex", "ris")


class _Row:
    """The pieces of a citation that styles share."""

    def __init__(self):
        self.n = F.coalesce(F.size("authors"), F.lit(0))
        self.names = F.coalesce(F.col("authors"), F.array().cast("array<string>"))
        self.article = F.col("resource_type") == "article"
        self.year = F.substring(text(F.col("date")), 1, 4)
        self.title = F.coalesce(F.col("title"), F.lit("Untitled"))
        self.pages = page_range()
        self.link = filled(doi_url(F.col("doi")))

    def get(self, name: str) -> Column:
        return text(F.col(name))

    def part(self, before: str, name: str | Column, after: str = "") -> Column:
        """A piece with what surrounds it, or nothing if it is empty."""
        value = self.get(name) if isinstance(name, str) else name
        return F.when(value == "", "").otherwise(F.concat(F.lit(before), value, F.lit(after)))


def _join(names: Column, sep: str) -> Column:
    return F.array_join(names, sep)


def _upto(names: Column, n: Column | int) -> Column:
    return F.slice(names, 1, n if isinstance(n, Column) else F.lit(n))


def apa() -> Column:
    r = _Row()
    who = F.transform(r.names, initialled)
    last = F.try_element_at(who, F.lit(-1))
    people = (
        F.when(r.n == 1, F.get(who, F.lit(0)))
        .when(r.n == 2, _join(who, " & "))
        .when(r.n.between(3, 20), F.concat(_join(_upto(who, r.n - 1), ", "), F.lit(", & "), last))
        .when(r.n > 20, F.concat(_join(_upto(who, 19), ", "), F.lit(", ... "), last))
    )
    year = F.concat(F.lit("("), F.when(F.col("date").isNull(), "n.d.").otherwise(r.year), F.lit(")."))
    volume = F.when(r.get("volume") == "", "").otherwise(F.concat(F.lit(", "), r.get("volume"), r.part("(", "issue", ")")))
    journal = F.when(r.get("source") != "", F.concat(r.get("source"), volume, r.part(", ", r.pages), F.lit(".")))
    tail = F.when(r.article, journal).otherwise(filled(r.part("", "publisher", ".")))
    return F.concat_ws(" ", people, year, F.concat(r.title, F.lit(".")), tail, r.link)


def _quoted(r: _Row) -> Column:
    return F.when(r.article, F.concat(F.lit('"'), r.title, F.lit('."'))).otherwise(F.concat(r.title, F.lit(".")))


def mla() -> Column:
    r = _Row()
    who = F.transform(r.names, plain)
    people = F.when(r.n == 1, F.concat(F.get(who, F.lit(0)), F.lit("."))).when(r.n == 2, F.concat(_join(who, ", and "), F.lit("."))).when(r.n > 2, F.concat(F.get(who, F.lit(0)), F.lit(", et al.")))
    journal = F.when(
        r.get("source") != "",
        F.concat(r.get("source"), r.part(", vol. ", "volume"), r.part(", no. ", "issue"), r.part(", ", r.year), r.part(", pp. ", r.pages), F.lit(".")),
    )
    house = F.concat_ws(", ", filled(r.get("publisher")), filled(r.year))
    tail = F.when(r.article, journal).otherwise(filled(r.part("", house, ".")))
    return F.concat_ws(" ", people, _quoted(r), tail, r.link)


def chicago() -> Column:
    r = _Row()
    who = F.transform(r.names, plain)
    several = F.concat(_join(_upto(who, r.n - 1), ", "), F.lit(", and "), F.try_element_at(who, F.lit(-1)), F.lit("."))
    people = F.when(r.n == 1, F.concat(F.get(who, F.lit(0)), F.lit("."))).when(r.n.between(2, 3), several).when(r.n > 3, F.concat(F.get(who, F.lit(0)), F.lit(", et al.")))
    journal = F.when(
        r.get("source") != "",
        F.concat(r.get("source"), r.part(" ", "volume"), r.part(", no. ", "issue"), r.part(" (", r.year, ")"), r.part(": ", r.pages), F.lit(".")),
    )
    house = F.when(r.get("publisher") != "", F.concat(r.get("publisher"), r.part(", ", r.year), F.lit(".")))
    tail = F.when(r.article, journal).otherwise(house)
    return F.concat_ws(" ", people, _quoted(r), tail, r.link)


def _letters(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))


def bibtex() -> Column:
    r = _Row()
    name = F.when(r.n > 0, F.substring_index(plain(F.get(r.names, F.lit(0))), ",", 1)).otherwise("unknown")
    word = F.coalesce(filled(F.get(F.filter(F.split(text(F.col("title")), r"(?U)\s+"), lambda x: x != ""), F.lit(0))), F.lit("untitled"))
    key = F.concat(_letters(name), F.when(r.year == "", "YYYY").otherwise(r.year), _letters(word))

    def line(field: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"  {field} = {{"), value, F.lit("},")))

    def only(cond: Column, c: Column) -> Column:
        return F.when(cond, c)

    return F.concat_ws(
        "\n",
        F.concat(F.lit("@"), F.when(r.article, "article").otherwise("book"), F.lit("{"), key, F.lit(",")),
        F.when(r.n > 0, F.concat(F.lit("  author = {"), _join(F.transform(r.names, plain), " and "), F.lit("},"))),
        line("title", text(F.col("title"))),
        line("year", r.year),
        only(r.article, line("journal", r.get("source"))),
        only(r.article, line("volume", r.get("volume"))),
        only(r.article, line("number", r.get("issue"))),
        only(r.article, line("pages", r.pages)),
        only(~r.article, line("publisher", r.get("publisher"))),
        line("isbn", r.get("isbn")),
        line("issn", r.get("issn")),
        line("doi", r.get("doi")),
        F.lit("}"),
    )


def ris() -> Column:
    r = _Row()

    def line(tag: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{tag}  - "), value))

    def both(article: Column, other: Column | None = None) -> Column:
        return F.when(r.article, article) if other is None else F.when(r.article, article).otherwise(other)

    none = F.lit(None).cast("string")
    return F.concat_ws(
        "\n",
        F.when(r.article, "TY  - JOUR").otherwise("TY  - BOOK"),
        F.when(r.n > 0, _join(F.transform(r.names, lambda a: F.concat(F.lit("AU  - "), plain(a))), "\n")),
        line("TI", text(F.col("title"))),
        line("PY", r.year),
        both(line("JO", r.get("source")), none),
        both(line("VL", r.get("volume")), none),
        both(line("IS", r.get("issue")), none),
        both(line("SP", r.get("spage")), none),
        both(line("EP", r.get("epage")), line("PB", r.get("publisher"))),
        line("SN", r.get("isbn")),
        line("SN", r.get("issn")),
        line("DO", r.get("doi")),
        F.lit("ER  -"),
    )


def render(style: str) -> Column:
    """A citation in a style; an unknown one falls back to APA."""
    return {"apa": apa, "mla": mla, "chicago": chicago, "bibtex": bibtex, "ris": ris}.get(style.lower(), apa)()


def citations(metadata: DataFrame, style: str = "apa") -> DataFrame:
    return metadata.select("record_id", render(style).alias("citation"))


#: What stands for a record without metadata.
MISSING = {"bibtex": "% Unable to generate citation: no metadata available.", "ris": "TY  - GEN\nER  -"}


def missing(style: str) -> str:
    return MISSING.get(style.lower(), "Unable to generate citation: no metadata available.")


def file_name(r=F.col) -> Column:
    """A readable name for a copy of the text: family name, year and title, 200 characters at most."""
    from ..functions.people import family

    who = F.when(F.coalesce(F.size(r("authors")), F.lit(0)) > 0, family(F.get(r("authors"), F.lit(0))))
    title = F.trim(F.regexp_replace(F.substring(text(r("title")), 1, 80), r'[<>:"/\\|?*]', ""))
    stem = F.concat_ws(" - ", filled(text(who)), filled(F.substring(text(r("date")), 1, 4)), filled(title))
    name = F.concat(F.when(stem == "", r("record_id")).otherwise(stem), F.lit(".pdf"))
    return F.when(F.length(name) > 200, F.concat(F.substring(name, 1, 196), F.lit(".pdf"))).otherwise(name)
