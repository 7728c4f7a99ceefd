"""Nested catalogue records to flat metadata, and metadata to library items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import people
from ..functions.text import clean, filled, first, first_of, has, text

JOINED = " ; "


def _col(name: str) -> Column:
    return F.col(name)


def _list(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))


def authors(r=_col) -> Column:
    """Creators; one that joins several by ' ; ' gives way to separate lists, or is split."""
    creator, au, found = _list(r("creator")), _list(r("au")), _list(r("s_creator"))

    def one_joined(x: Column) -> Column:
        return (F.size(x) == 1) & F.coalesce(F.get(x, F.lit(0)).contains(JOINED), F.lit(False))

    split = F.filter(F.transform(F.split(first(creator), JOINED), lambda x: F.trim(x)), lambda x: x != "")
    apart = F.when(has(au), au).when(has(found) & ~one_joined(found), found).otherwise(split)
    return F.when(one_joined(creator), apart).when(has(creator), creator).when(has(au), au).when(has(found), found).otherwise(_list(r("contributor")))


def date(r=_col) -> Column:
    return first_of(first(r("creationdate")), F.substring(first(r("ad_date")), 1, 4), first(r("s_creationdate")))


def is_central(record_id: Column) -> Column:
    """Records from the central index."""
    return F.coalesce(record_id.startswith("TN_cdi_"), F.lit(False))


def journal(r=_col) -> Column:
    """The journal's title first for central records, whose source is a database; else the source first."""
    title, source = first(r("jtitle")), first(r("source"))
    return clean(F.when(is_central(r("record_id")), first_of(title, source)).otherwise(first_of(source, title)))


def resource_type(kind: Column) -> Column:
    k = F.lower(text(kind))
    return F.when(k.contains("article") | k.contains("journal"), "article").when(k.contains("book"), "book").otherwise("other")


def extract(records: DataFrame) -> DataFrame:
    """The flat metadata of records, one row each."""
    r = _col
    plain = {c: first(r(c)) for c in ("publisher", "type", "isbn", "issn", "doi", "volume", "issue", "spage", "epage", "pages")}
    return records.select(
        clean(first(r("title"))).alias("title"),
        authors().alias("authors"),
        _list(r("creator")).alias("creators"),
        _list(r("contributor")).alias("contributors"),
        date().alias("date"),
        clean(plain["publisher"]).alias("publisher"),
        plain["type"].alias("type"),
        journal().alias("source"),
        *(plain[c].alias(c) for c in ("isbn", "issn", "doi", "volume", "issue", "spage", "epage", "pages")),
        text(r("record_id")).alias("record_id"),
        is_central(r("record_id")).alias("is_cdi"),
        resource_type(plain["type"]).alias("resource_type"),
    )


def page_range(lone_end: bool = True, r=_col) -> Column:
    """`pages`, else start-end without a hyphen at either end. Items ignore an end without a start."""
    s, e = text(r("spage")), text(r("epage"))
    both = F.concat(s, F.lit("-"), e)
    if lone_end:
        return first_of(text(r("pages")), F.regexp_replace(both, "^-+|-+$", ""))
    return first_of(text(r("pages")), F.when((s != "") & (e != ""), both).otherwise(s))


def items(metadata: DataFrame, trace_prefix: str = "Record-ID") -> DataFrame:
    """Library items from metadata."""
    kind = F.when(F.col("resource_type") == "article", "journalArticle").when(F.col("resource_type") == "book", "book").otherwise("document")
    who = F.when(has(F.col("authors")), F.col("authors")).otherwise(F.col("creators"))
    return metadata.select(
        kind.alias("item_type"),
        "title",
        F.transform(who, people.person).alias("creators"),
        "date",
        "doi",
        "isbn",
        "issn",
        "volume",
        "issue",
        page_range(lone_end=False).alias("pages"),
        F.when(kind == "book", "").otherwise(F.col("source")).alias("publication_title"),
        F.when(kind == "journalArticle", "").otherwise(F.col("publisher")).alias("publisher"),
        F.when(F.col("record_id") == "", "").otherwise(F.concat(F.lit(f"{trace_prefix}: "), F.col("record_id"))).alias("extra"),
        "record_id",
    )


def item_rows(items: DataFrame) -> DataFrame:
    """Items as flat rows with shown authors."""
    return items.select(
        "key",
        "title",
        F.filter(F.transform("creators", people.shown), lambda x: x.isNotNull()).alias("authors"),
        "date",
        "item_type",
        "doi",
        "isbn",
        first_of(text(F.col("publication_title")), text(F.col("publisher"))).alias("publication"),
        "collections",
        "tags",
    )


def item_summary(rows: DataFrame) -> DataFrame:
    """key and summary, a line for each field that is filled."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), filled(value))

    lists = {c: F.array_join(c, sep) for c, sep in (("authors", "; "), ("tags", ", "), ("collections", ", "))}
    parts = [
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit("Untitled"))),
        line("Authors", lists["authors"]),
        line("Date", F.col("date")),
        line("Type", F.col("item_type")),
        line("Publication", F.col("publication")),
        line("DOI", F.col("doi")),
        line("ISBN", F.col("isbn")),
        line("Tags", lists["tags"]),
        line("Collections", lists["collections"]),
        line("Key", F.col("key")),
    ]
    return rows.select("key", F.concat_ws("\n", *parts).alias("summary"))


def registry_works(works: DataFrame) -> DataFrame:
    """Metadata of works of a DOI registry: columns DOI, title, author (family, given), issued print and online years,
    container, publisher, volume, issue, page, ISSN, ISBN, type."""
    name = F.transform("author", lambda a: F.concat_ws(", ", filled(text(a["family"])), filled(text(a["given"]))))
    pages = text(F.col("page"))
    year = F.coalesce(F.col("print_year"), F.col("online_year")).cast("string")
    return works.select(
        F.col("doi").alias("doi"),
        first(F.col("title")).alias("title"),
        F.filter(name, lambda x: x != "").alias("authors"),
        text(year).alias("date"),
        first(F.col("container")).alias("source"),
        text(F.col("publisher")).alias("publisher"),
        text(F.col("volume")).alias("volume"),
        text(F.col("issue")).alias("issue"),
        F.substring_index(pages, "-", 1).alias("spage"),
        F.when(F.instr(pages, "-") > 0, F.substring(pages, F.instr(pages, "-") + 1, F.length(pages))).otherwise("").alias("epage"),
        pages.alias("pages"),
        first(F.col("issn")).alias("issn"),
        first(F.col("isbn")).alias("isbn"),
        F.when(F.lower(text(F.col("type"))).contains("article"), "article").otherwise("other").alias("resource_type"),
    )
