"""A catalogue derived from the documents table: bibliographic fields by integer arithmetic on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metadata import extract, items
from .tables import table

#: Types by id % 7, and availabilities by id % 5.
TYPES = ("article", "book", "book_chapter", "conference_proceeding", "dissertation", "review", "journal_article")


def _digits(n: int) -> str:
    return f"lpad(cast(doc_id as string), {n}, '0')"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kinds = ", ".join(f"'{t}'" for t in TYPES)
    base = docs.selectExpr(
        "doc_id",
        "lang",
        "source as src",
        f"case when doc_id % 3 = 0 then concat('TN_cdi_', {_digits(10)}) else concat('alma99', {_digits(10)}) end as record_id",
        "case when doc_id % 97 = 0 then '' else trim(substring(replace(text, '\\n', ' '), 1, 80)) end as t",
        "cast(1995 + doc_id % 30 as string) as y",
        f"element_at(array({kinds}), cast(doc_id % 7 as int) + 1) as k",
        f"concat('978', {_digits(9)}) as stem",
        "concat('Last', doc_id % 50, ', First', doc_id % 7, ' M.$$QLast', doc_id % 50) as a1",
        "concat('Last', (doc_id + 1) % 50, ', First', (doc_id + 1) % 7, ' M.$$QLast', (doc_id + 1) % 50) as a2",
    )
    empty = "cast(array() as array<string>)"
    book = "k in ('book', 'book_chapter')"
    both = "case when doc_id % 2 = 0 then array(a1, a2) else array(a1) end"
    check = "(10 - aggregate(sequence(1, 12), 0, (s, i) -> s + cast(substring(stem, i, 1) as int) * if(i % 2 = 1, 1, 3)) % 10) % 10"
    return base.selectExpr(
        "doc_id",
        "record_id",
        "array(t) as title",
        f"case when doc_id % 3 = 0 then array(array_join({both}, ' ; ')) else {both} end as creator",
        f"{empty} as contributor",
        "array(case when doc_id % 11 = 0 then '' when doc_id % 13 = 0 then concat('c', y) else y end) as creationdate",
        "array(concat('Press ', doc_id % 9)) as publisher",
        "array(k) as type",
        "array(src) as source",
        f"{empty} as description",
        "array(lang, src, concat(lang, '--', src, '$$Qx')) as subject",
        f"case when {book} then array(concat(stem, {check})) else {empty} end as isbn",
        f"{empty} as issn",
        f"case when doc_id % 4 <> 0 then array(concat('10.', 1000 + doc_id % 9, '/d.', doc_id)) else {empty} end as doi",
        *(f"case when {book} then {empty} else array(cast({e} as string)) end as {c}" for c, e in (("volume", "doc_id % 40"), ("issue", "doc_id % 12"), ("spage", "doc_id % 500"), ("epage", "doc_id % 500 + 14"))),
        f"{empty} as pages",
        "case when doc_id % 3 = 0 then array(concat('Journal of ', src)) else array() end as jtitle",
        f"case when doc_id % 6 = 0 then {both} else {empty} end as au",
        "array(concat(y, '-07-01')) as ad_date",
        f"{empty} as s_creator",
        "array(y) as s_creationdate",
        f"{empty} as linktohtml",
        f"{empty} as linktopdf",
        f"case when doc_id % 3 = 1 then array(concat('$$Uhttps://host', doc_id % 12, '.example.com/', doc_id, '$$EHTML')) else {empty} end as linktorsrc",
        "case when doc_id % 10 = 1 then array('free_for_read') else array() end as openaccess",
        f"{empty} as openurl",
        f"case doc_id % 5 when 0 then array('available') when 1 then array('unavailable') when 2 then array('available_online') when 3 then array('') else {empty} end as availability",
        "array(named_struct('libraryCode', concat('L', doc_id % 3), 'subLocationCode', concat('S', doc_id % 5), 'callNumber', concat('QA', doc_id % 99))) as holding",
        "doc_id % 8 = 0 as is_course",
    )


def full_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the fields that `catalog` leaves empty, by arithmetic on ids: contributors, descriptions, ISSNs,
    pages, creators of the search section, links to pages and PDFs, and records without a creator, an id or a source."""
    empty = "cast(array() as array<string>)"
    base = catalog(spark, sf_dir)
    new = {
        "record_id": "case when doc_id % 17 = 0 then '' else record_id end",
        "creator": f"case when doc_id % 5 = 0 then {empty} else creator end",
        "au": f"case when doc_id % 10 = 0 then array(concat('Au', doc_id % 7, ', A.')) else au end",
        "s_creator": f"case when doc_id % 10 = 5 and doc_id % 3 = 0 then array(concat('Found', doc_id % 7, ', B.')) else {empty} end",
        "contributor": "array(concat('Ed', doc_id % 8, ', Chris'))",
        "description": f"case when doc_id % 4 = 1 then array(concat('About ', subject[0], ' and more'), 'Second part') else {empty} end",
        "issn": f"case when doc_id % 7 in (0, 6) then array(concat(lpad(cast(doc_id % 9999 as string), 4, '0'), '-0000')) else {empty} end",
        "pages": f"case when doc_id % 6 = 1 then array(concat('e', doc_id % 100)) else {empty} end",
        "linktohtml": f"case when doc_id % 4 = 2 then array(concat('https://h.example.com/', doc_id), '') else {empty} end",
        "linktopdf": f"case when doc_id % 5 = 3 then array(concat('$$Uhttps://p.example.com/', doc_id, '.pdf$$EPDF')) else {empty} end",
        "openurl": f"case when doc_id % 9 = 4 then array('u') else {empty} end",
        "jtitle": f"case when doc_id % 4 = 0 then array(concat('Full journal ', doc_id % 6)) else {empty} end",
        "source": f"case when doc_id % 8 = 3 then {empty} else source end",
        "availability": f"case when doc_id % 2 = 0 then {empty} else availability end",
    }
    return base.selectExpr(*(f"{new.get(c, c)} as {c}" for c in base.columns))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library items: the catalogue records of labelled documents. Collections by language, tags by source."""
    cat = catalog(spark, sf_dir)
    owned = cat.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    rows = items(extract(owned)).join(owned.select("record_id", "doc_id", F.get("subject", F.lit(0)).alias("lang")), "record_id")
    return rows.withColumns(
        {
            "key": F.upper(F.lpad(F.hex("doc_id"), 8, "K")),
            "collections": F.array(F.concat(F.lit("COL"), F.col("lang"))),
            "tags": F.array("lang"),
            "num_children": (F.col("doc_id") % 3).cast("int"),
        }
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").cast("int").alias("num_items"))
    return langs.select(F.concat(F.lit("COL"), "lang").alias("key"), F.concat(F.lit("Texts "), "lang").alias("name"), F.lit("ROOT").alias("parent_key"), "num_items")


def attachments(library_items: DataFrame) -> DataFrame:
    """Children of library items: none, one, or two, of which the second is a note."""
    kids = library_items.filter("num_children > 0").select("key", "doc_id", F.explode(F.expr("sequence(1, num_children)")).alias("n"))
    kind = F.when(F.col("doc_id") % 2 == 0, "application/pdf").when(F.col("doc_id") % 5 == 0, "application/x-PDF").otherwise("text/html")
    return kids.select(
        F.concat("key", F.lit("-"), F.col("n").cast("string")).alias("key"),
        F.col("key").alias("parent_key"),
        F.when(F.col("n") == 1, "attachment").otherwise("note").alias("item_type"),
        F.when(F.col("n") == 1, kind).otherwise("").alias("content_type"),
    )
