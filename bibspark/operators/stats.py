"""Statistics of result lists, calls, logs and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first, has


def electronic(r=F.col) -> Column:
    """A link to the full text, or an availability that holds 'online' or 'available'; so 'unavailable' counts."""
    a = F.lower(first(r("availability")))
    return has(r("linktorsrc")) | has(r("linktohtml")) | a.contains("online") | a.contains("available")


def top_subjects(docs: DataFrame, per_doc: int = 3, most: int = 5) -> DataFrame:
    """The first distinct subjects of a ranked list: those of its documents in order, cut at subfield marks, each in the
    spelling met first. docs: position, subject."""
    rows = docs.select("position", F.posexplode(F.slice("subject", 1, per_doc)).alias("k", "s")).select("position", "k", F.substring_index("s", "$$", 1).alias("subject"))
    at = F.struct("position", "k")
    distinct = rows.filter("subject <> ''").groupBy(F.lower("subject").alias("subject_key")).agg(F.min(at).alias("at"), F.min_by("subject", at).alias("subject"))
    return distinct.select("subject", F.col("at.position").alias("position"), F.col("at.k").alias("k")).orderBy("position", "k").limit(most)


def electronic_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.count_if(electronic()).alias("n_electronic"))


def call_metrics(calls: DataFrame) -> DataFrame:
    """tool, count, errors, total and mean latency, by name. calls: tool, latency, failed."""
    return calls.groupBy("tool").agg(F.count("*").alias("n"), F.count_if("failed").alias("n_errors"), F.sum("latency").alias("total_latency"), F.avg("latency").alias("avg_latency")).orderBy("tool")


def severe(line: Column, strict: bool = False) -> Column:
    """Lines of errors and warnings: strict wants the word between spaces, otherwise brackets do as well."""
    return line.contains(" ERROR ") | line.contains(" WARNING ") if strict else line.rlike(r"[\[ ](ERROR|WARNING)[\] ]")


def last_errors(lines: DataFrame, most: int = 10, strict: bool = False) -> DataFrame:
    """The last severe lines in file order, cut to 200 characters. lines: line_no, value."""
    some = lines.filter(severe(F.col("value"), strict)).orderBy(F.desc("line_no")).limit(most)
    return some.select("line_no", F.substring("value", 1, 200).alias("line")).orderBy("line_no")


def names_by_domain(cookies: DataFrame) -> DataFrame:
    """Cookie names of each domain, in order."""
    return cookies.groupBy("domain").agg(F.array_sort(F.collect_list("name")).alias("names"))


def health(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count("*").alias("n"))


def missing_required(required: DataFrame, found: DataFrame) -> DataFrame:
    return required.exceptAll(found)


def lacking_keys(keys: Column, required: list[str]) -> Column:
    """Required keys that a response lacks."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))


def facet(docs: DataFrame, column: Column, name: str) -> DataFrame:
    return docs.groupBy(column.alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")


def facets(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Counts of all facets in one pass: each row gives one (facet, value) pair per facet, summed up before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), c.cast("string").alias("value")) for k, c in columns.items()])
    return docs.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def recent_queries(events: DataFrame, since: Column, gap_seconds: int = 600) -> DataFrame:
    """Queries since a time, each marked as a refinement if the same user asked less than gap_seconds before."""
    w = Window.partitionBy("user_id").orderBy("micros", "event_id")
    out = events.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    out = out.withColumn("refinement", F.coalesce(F.col("micros") - F.lag("micros").over(w) < gap_seconds * 1_000_000, F.lit(False)))
    return out.filter(F.col("ts") >= since)
