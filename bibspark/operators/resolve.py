"""Batch lookups, enrichment, duplicates, attachments and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import bare, doi_bare
from ..functions.people import family
from ..functions.text import filled, first, normal_title, text, title_similarity
from ..session import written

SIMILAR = 0.85


def id_list(spark: SparkSession, ids: list[str], cap: int | None = None) -> DataFrame:
    """pos and id of a list; repeated ids stay."""
    rows = list(enumerate(ids if cap is None else ids[: max(cap, 0)]))
    return spark.createDataFrame(rows, "pos INT, id STRING")


def by_id(ids: DataFrame, records: DataFrame, key: str = "record_id") -> DataFrame:
    """A row for each place of the list in order, misses included: pos, id, found and the record."""
    return ids.join(records.withColumnRenamed(key, "_key"), F.col("id") == F.col("_key"), "left").withColumn("found", F.col("_key").isNotNull()).withColumnRenamed("_key", key).orderBy("pos")


def by_isbn(isbns: DataFrame, records: DataFrame) -> DataFrame:
    """The first record (by record_id) with each ISBN, compared without hyphens and spaces."""
    numbers = records.select("record_id", "title", F.explode("isbn").alias("isbn"))
    firsts = numbers.groupBy(bare(F.col("isbn")).alias("_isbn")).agg(F.min_by(F.struct("record_id", "title"), F.col("record_id")).alias("r"))
    out = isbns.join(firsts, bare(F.col("id")) == F.col("_isbn"), "left")
    return out.select("pos", "id", F.col("r").isNotNull().alias("found"), F.col("r.record_id").alias("record_id"), F.substring(first(F.col("r.title")), 1, 60).alias("title")).orderBy("pos")


def tally(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if("found").alias("n_found"), F.count_if(~F.col("found")).alias("n_missing"))


def coalesce_sources(ids: DataFrame, sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Each id's columns from the first source that knows it."""
    out = ids
    for i, s in enumerate(sources):
        out = out.join(s.select(F.col(key).alias(f"_k{i}"), F.struct(*columns).alias(f"_s{i}")), F.col("id") == F.col(f"_k{i}"), "left")
    known = F.coalesce(*[F.when(F.col(f"_k{i}").isNotNull(), F.col(f"_s{i}")) for i in range(len(sources))])
    level = F.coalesce(*[F.when(F.col(f"_k{i}").isNotNull(), F.lit(i)) for i in range(len(sources))])
    return out.select(*ids.columns, level.alias("source_no"), known.alias("_r")).select(*ids.columns, "source_no", "_r.*")


def enrich(metadata: DataFrame, registry: DataFrame) -> DataFrame:
    """Fills authors, date, source and more from a registry by DOI, only where one of the three is missing and a DOI is
    there. Only these rows are joined."""
    incomplete = (text(F.col("doi")) != "") & ((F.coalesce(F.size("authors"), F.lit(0)) == 0) | (text(F.col("date")) == "") | (text(F.col("source")) == ""))
    fields = ("date", "source", "volume", "issue", "spage", "epage", "publisher")
    have = [c for c in fields if c in registry.columns]
    # of several rows of a DOI, the least by all columns: the same in every run
    row = F.struct(F.col("authors").alias("_authors"), *(F.col(c).alias(f"_{c}") for c in have))
    theirs = registry.groupBy(F.lower(doi_bare(F.col("doi"))).alias("_doi")).agg(F.min(row).alias("_row")).select("_doi", "_row.*")
    joined = metadata.filter(incomplete).join(theirs, F.lower(doi_bare(F.col("doi"))) == F.col("_doi"), "left")
    new: dict[str, Column] = {c: F.coalesce(filled(text(F.col(c))), F.col(f"_{c}"), F.lit("")) for c in have if c in metadata.columns}
    new["authors"] = F.when(F.coalesce(F.size("authors"), F.lit(0)) > 0, F.col("authors")).otherwise(F.coalesce("_authors", "authors"))
    filled_in = joined.select(*(new.get(c, F.col(c)).alias(c) for c in metadata.columns), F.col("_doi").isNotNull().alias("enriched"))
    return filled_in.unionByName(metadata.filter(~incomplete).withColumn("enriched", F.lit(False)))


def _doi() -> Column:
    return F.lower(F.trim(text(F.col("doi"))))


def _isbn() -> Column:
    return F.replace(text(F.col("isbn")), F.lit("-"), F.lit(""))


def _same(records: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """record_id and the first item with an equal key. Items are summed up to one row per key before they meet records."""
    firsts = items.filter(F.col(key) != "").groupBy(key).agg(F.min("item_key").alias("item_key"))
    found = records.filter(F.col(key) != "").select("record_id", key).join(firsts, key)
    return found.groupBy("record_id").agg(F.min("item_key").alias("item_key"))


def same_doi(metadata: DataFrame, items: DataFrame) -> DataFrame:
    return _same(metadata.select("record_id", _doi().alias("k")), items.select(F.col("key").alias("item_key"), _doi().alias("k")), "k")


def same_isbn(metadata: DataFrame, items: DataFrame) -> DataFrame:
    return _same(metadata.select("record_id", _isbn().alias("k")), items.select(F.col("key").alias("item_key"), _isbn().alias("k")), "k")


def _titled(name: Column) -> list[Column]:
    return [F.lower(name).alias("who"), normal_title(F.col("title")).alias("t")]


def _of_records(metadata: DataFrame) -> DataFrame:
    """What a record is compared by: record_id, doi, isbn, who and t (name and title)."""
    return metadata.select("record_id", _doi().alias("doi"), _isbn().alias("isbn"), *_titled(family(F.get("authors", F.lit(0)))))


def _of_items(items: DataFrame) -> DataFrame:
    return items.select(F.col("key").alias("item_key"), _doi().alias("doi"), _isbn().alias("isbn"), *_titled(text(F.get("creators", F.lit(0))["lastName"])))


def same_title(metadata: DataFrame, items: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Titles more similar than a share, with the same first author's family name."""
    return _same_title(_of_records(metadata), _of_items(items), least)


def _same_title(records: DataFrame, items: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Titles as similar as that share all but a few of their words, so in any fixed order of words one of the first
    n - ceil(share * n) + 1 is common to both. Words are ordered by how many titles hold them, rare ones first, and titles
    meet by name and one of these words: frequent words bring nobody together unless a title has no others. Equal titles
    of a name are one row on either side until their match is known."""
    filled_in = (F.col("who") != "") & (F.col("t") != "")
    mine = records.filter(filled_in).select("who", "t").distinct()
    theirs = items.filter(filled_in).groupBy("who", "t").agg(F.min("item_key").alias("item_key"))

    def worded(df: DataFrame) -> DataFrame:
        return df.withColumn("w", F.explode(F.array_distinct(F.split("t", " "))))

    often = worded(mine.select("t").unionByName(theirs.select("t"))).groupBy("w").agg(F.count("*").alias("often"))

    def rare(df: DataFrame, title: str, *more: str) -> DataFrame:
        ranked = worded(df).join(often, "w").groupBy("who", "t", *more).agg(F.sort_array(F.collect_list(F.struct("often", "w"))).alias("ws"))
        n = (F.size("ws") - F.ceil(F.size("ws") * least) + 1).cast("int")
        return ranked.select("who", F.col("t").alias(title), *more, F.explode(F.slice("ws", 1, n)["w"]).alias("w"))

    pairs = rare(mine, "t").join(rare(theirs, "u", "item_key"), ["who", "w"]).filter(title_similarity(F.col("t"), F.col("u")) > least)
    found = pairs.groupBy("who", "t").agg(F.min("item_key").alias("item_key"))
    return records.select("record_id", "who", "t").join(found, ["who", "t"]).groupBy("record_id").agg(F.min("item_key").alias("item_key"))


def duplicates(metadata: DataFrame, items: DataFrame) -> DataFrame:
    """record_id, match_type (doi, isbn, title_author or none) and item_key; the first test that matches decides.

    What records and items are compared by is computed once and written to the shared folder, narrow; the tests read that.
    Titles are compared only for records without another match. Runs these jobs when it is called."""
    records, theirs = written(_of_records(metadata)), written(_of_items(items))
    ids = records.select("record_id").distinct()
    d = _same(records, theirs, "doi").withColumnRenamed("item_key", "by_doi")
    i = _same(records, theirs, "isbn").withColumnRenamed("item_key", "by_isbn")
    known = written(ids.join(d, "record_id", "left").join(i, "record_id", "left"))
    rest = records.join(known.filter("by_doi IS NULL AND by_isbn IS NULL"), "record_id", "left_semi")
    out = known.join(_same_title(rest, theirs).withColumnRenamed("item_key", "by_title"), "record_id", "left")
    kind = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_isbn").isNotNull(), "isbn").when(F.col("by_title").isNotNull(), "title_author").otherwise("none")
    return out.select("record_id", kind.alias("match_type"), F.coalesce("by_doi", "by_isbn", "by_title").alias("item_key"))


def save_statuses(wanted: DataFrame, metadata: DataFrame, items: DataFrame) -> DataFrame:
    """pos, id and status of a batch: failed (unknown), skipped (a duplicate, or a repeated id), saved."""
    again = F.row_number().over(Window.partitionBy("id").orderBy("pos")) > 1
    known = duplicates(metadata.join(wanted.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi"), items)
    joined = wanted.withColumn("_again", again).join(known, F.col("id") == F.col("record_id"), "left")
    status = F.when(F.col("match_type").isNull(), "failed").when((F.col("match_type") != "none") | F.col("_again"), "skipped").otherwise("saved")
    return joined.select("pos", "id", status.alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def traced(items: DataFrame, record_id: str, prefix: str) -> DataFrame:
    """Items whose trace holds an id; a longer id that starts with it counts too."""
    return items.filter(F.col("extra").contains(f"{prefix}: {record_id}"))


def is_item_key(value: Column) -> Column:
    return value.rlike("^[A-Z0-9]{8}$")


def pdf_child(loose: bool = True) -> Column:
    """A child that is a PDF: its type holds 'pdf', or (not loose) is the PDF type."""
    kind = F.lower(text(F.col("content_type")))
    return (F.col("item_type") == "attachment") & (kind.contains("pdf") if loose else kind == "application/pdf")


def without_pdf(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """Items, no attachments or notes themselves, that have no PDF child."""
    whole = items.filter(~F.col("item_type").isin("attachment", "note"))
    children = attachments.filter(pdf_child()).select(F.col("parent_key").alias("key"))
    return whole.join(children, "key", "left_anti")


def first_pdf(attachments: DataFrame) -> DataFrame:
    """The first PDF child of each item, by key."""
    return attachments.filter(pdf_child(loose=False)).groupBy("parent_key").agg(F.min("key").alias("pdf_key"))


def find_collection(collections: DataFrame, name: str, parent_key: str | None = None) -> DataFrame:
    """The first collection of a name, in any case, below a parent if one is given."""
    rows = collections.filter(F.lower("name") == name.lower())
    if parent_key is not None:
        rows = rows.filter(F.col("parent_key") == parent_key)
    return rows.orderBy("key").limit(1)


def upsert_collection(collections: DataFrame, new: DataFrame) -> DataFrame:
    """Collections with the new ones that they lack, by name in any case and parent; of new ones alike, the first by key."""
    mine = collections.select(F.lower("name").alias("_n"), F.col("parent_key").alias("_p"))
    others = [c for c in new.columns if c not in ("name", "parent_key")]
    once = new.groupBy(F.lower("name").alias("_l"), "parent_key").agg(F.min_by(F.struct("name", *others), F.col("key")).alias("_r")).select("_l", "parent_key", "_r.*")
    lacking = once.join(mine, (F.col("_l") == F.col("_n")) & F.col("parent_key").eqNullSafe(F.col("_p")), "left_anti")
    return collections.unionByName(lacking.select(collections.columns))


def new_collection(spark: SparkSession, name: str, parent_key: str | None) -> DataFrame:
    """A row of a collection to be made; its key hangs on the name and the parent, so that making it twice is making it once."""
    import hashlib

    key = hashlib.sha256(f"{parent_key or ''}/{name.lower()}".encode()).hexdigest()[:8].upper()
    return spark.createDataFrame([(key, name, parent_key, 0)], "key STRING, name STRING, parent_key STRING, num_items INT")


def find_or_create(collections: DataFrame, name: str, parent_key: str | None = None) -> tuple[DataFrame, str]:
    """The collections with one of a name, made if there is none, and its key: one row is fetched. Without a parent any
    collection of the name will do."""
    there = find_collection(collections, name, parent_key).select("key").first()
    if there is not None:
        return collections, there["key"]
    new = new_collection(collections.sparkSession, name, parent_key)
    return upsert_collection(collections, new), new.first()["key"]


def members(items: DataFrame, collections: DataFrame) -> DataFrame:
    """collection_key, name and item key of every membership."""
    inside = items.select(F.col("key").alias("item_key"), "title", F.explode("collections").alias("collection_key"))
    return inside.join(collections.select(F.col("key").alias("collection_key"), "name"), "collection_key")


def with_parents(collections: DataFrame) -> DataFrame:
    parent = collections.select(F.col("key").alias("_p"), F.col("name").alias("parent_name"))
    return collections.join(parent, F.col("parent_key") == F.col("_p"), "left").drop("_p")
