"""Re-ranking and rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import first, text

#: Fixed value: the constant of reciprocal rank fusion.
RRF = 60


def scored(docs: DataFrame, query: str, ref_year: int, strict: bool = False) -> DataFrame:
    """Adds the five signals and their weighted sum `score`."""
    parts = scoring.signals(F.col, F.lit(query), ref_year, strict)
    out = docs.select("*", *(c.alias(f"s_{n}") for n, c in parts.items()))
    return out.withColumn("score", scoring.composite({n: F.col(f"s_{n}") for n in parts}))


def rerank(docs: DataFrame, query: str, ref_year: int, limit: int, position: str = "position", strict: bool = False) -> DataFrame:
    """The best rows by score; ties keep their position. Plans as a top-k, never as a full sort."""
    return scored(docs, query, ref_year, strict).orderBy(F.desc("score"), F.asc(position)).limit(limit)


def cosine_rank(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id") -> DataFrame:
    """The vectors closest to one by cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, scoring.cosine(F.col("embedding"), q).alias("cosine")).orderBy(F.desc("cosine"), key).limit(limit)


def fuse(legs: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists with record_id, title and rank (from 0). A list that failed is None.

    A record counts once for each place it has; records without an id are told apart by the first 50 characters of their
    title. The row kept is the first by list, then rank. Scores are summed up in that order, so they are the same
    however the rows were dealt."""
    lists = [d.withColumn("list_no", F.lit(i)) for i, d in enumerate(x for x in legs if x is not None)]
    rows = reduce(lambda a, b: a.unionByName(b), lists)
    key = F.when(text(F.col("record_id")) == "", F.concat(F.lit("_fallback_"), F.substring(first(F.col("title")), 1, 50))).otherwise(F.col("record_id"))
    others = [c for c in rows.columns if c not in ("list_no", "rank")]
    places = F.array_sort(F.collect_list(F.struct("list_no", "rank")))
    found = rows.withColumn("fusion_key", key).groupBy("fusion_key").agg(
        places.alias("places"),
        F.min_by(F.struct(*others), F.struct("list_no", "rank")).alias("doc"),
    )
    score = F.aggregate("places", F.lit(0.0), lambda s, p: s + 1.0 / (RRF + p["rank"].cast("double")))
    at = F.get("places", F.lit(0))
    out = found.select("fusion_key", score.alias("rrf"), at["list_no"].alias("first_list"), at["rank"].alias("first_rank"), "doc.*")
    out = out.orderBy(F.desc("rrf"), "first_list", "first_rank")
    return out.limit(limit) if limit is not None else out


def top_within(rows: DataFrame, group: list[str], order: list, spread: str, most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each group with their rank (from 0). Groups are cut to parts by a hash of `spread`, and each
    part to its first rows, before the rows that are left are ranked together: a hot group is never sorted whole in one
    task."""
    part = F.pmod(F.xxhash64(spread), F.lit(64))
    cut = rows.withColumn("_part", part).withColumn(name, F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).filter(F.col(name) <= most).drop("_part", name)
    return cut.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).filter(F.col(name) < most)


def fusion_total(totals: list[int]) -> int:
    """The total of fused lists: the largest of theirs."""
    return max(totals, default=0)


def ranked(docs: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Positions from 0 of a list that is already cut to a few rows."""
    return docs.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
