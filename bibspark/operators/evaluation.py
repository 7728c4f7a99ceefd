"""Retrieval quality of runs against relevance judgements, and summaries of latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import doi_key
from ..functions.scoring import discount
from ..functions.text import text
from .ranking import top_within


def metrics(run: DataFrame, qrels: DataFrame, k: int = 10, keys_are_dois: bool = True) -> DataFrame:
    """ndcg, mrr and recall at k of every query of the judgements. run: query_id, rank (from 0), doc_key; qrels:
    query_id, doc_key. Each document counts once, at its first rank; the ideal has min(relevant, k) documents."""

    def key(c: Column) -> Column:
        return doi_key(c) if keys_are_dois else c

    rel = qrels.select("query_id", key(F.col("doc_key")).alias("doc_key")).filter("doc_key <> ''").distinct()
    places = run.filter(F.col("rank") < k).select("query_id", "rank", key(F.col("doc_key")).alias("doc_key"))
    found = places.join(rel, ["query_id", "doc_key"]).groupBy("query_id", "doc_key").agg(F.min("rank").alias("rank"))
    ranks = found.groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    out = n_rel.join(ranks, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))

    def gain(places: Column) -> Column:
        return F.aggregate(places, F.lit(0.0), lambda s, p: s + discount(p))

    ideal = gain(F.sequence(F.lit(0), F.least(F.col("n_rel"), F.lit(k)).cast("int") - 1))
    return out.select(
        "query_id",
        "n_rel",
        F.coalesce(F.try_divide(gain(F.col("ranks")), ideal), F.lit(0.0)).alias("ndcg"),
        F.coalesce(1.0 / (F.get("ranks", F.lit(0)) + 1), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide(F.size("ranks").cast("double"), F.col("n_rel")), F.lit(0.0)).alias("recall"),
    )


def seed_found(run: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """Whether each query's seed is in the top k; null without a seed."""
    top = run.filter(F.col("rank") < k).select("query_id", doi_key(F.col("doc_key")).alias("doc_key"))
    both = seeds.select("query_id", doi_key(F.col("seed_doi")).alias("seed")).join(top, "query_id", "left")
    hit = F.bool_or(F.coalesce(F.col("doc_key") == F.col("seed"), F.lit(False)))
    return both.groupBy("query_id", "seed").agg(hit.alias("hit")).select("query_id", F.when(F.col("seed") != "", F.col("hit")).alias("seed_found"))


def mean(value: Column, places: int = 4) -> Column:
    return F.coalesce(F.round(F.avg(value), places), F.lit(0.0))


#: Parts that a group's values are cut to.
PARTS = 64


def exact_percentile(df: DataFrame, value: str, group: str | None, *ps: float) -> DataFrame:
    """Of each group (of all rows, without one) the elements at int(n * p) of the sorted values, the last at most, as p50, p95
    and so on; not interpolated.

    Groups are cut to parts by approximate quantiles of fixed accuracy, found in one pass; parts are counted before the
    shuffle, and only the part that holds the element sought is looked at value by value. Whatever the approximation, the
    counts make the result exact; it only decides how even the parts are."""
    g = F.col(group) if group else F.lit(0)
    some = df.filter(F.col(value).isNotNull()).select(g.alias("_g"), F.col(value).cast("double").alias("_v"))
    cuts = F.percentile_approx("_v", [k / PARTS for k in range(1, PARTS)], 10_000)
    edges = some.groupBy(F.col("_g").alias("_of")).agg(cuts.alias("_cuts"), F.count("*").alias("_n"))
    # a value's part: how many edges lie below it
    parts = some.join(edges, F.col("_g").eqNullSafe(F.col("_of"))).select("_g", "_v", "_n", F.size(F.filter("_cuts", lambda x: x < F.col("_v"))).alias("_part"))
    counts = parts.groupBy("_g", "_n", "_part").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = [F.least(F.floor(F.col("_n") * p), F.col("_n") - 1) for p in ps]
    held = counts.withColumn("_before", before).filter(F.exists(F.array(*places), lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_c"))))
    starts = held.select(F.col("_g").alias("_of"), F.col("_part").alias("_in"), "_before")
    inside = parts.join(starts, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    values = inside.groupBy("_g", "_n", "_part", "_before", "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = values.withColumn("_upto", F.col("_before") + F.sum("_c").over(w))
    out = upto.groupBy(F.col("_g").alias(group)) if group else upto
    return out.agg(*[F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k), F.col("_v"))).alias(f"p{round(p * 100)}") for p, k in zip(ps, places, strict=True)])


def summary(rows: DataFrame) -> DataFrame:
    """Overall means of query rows (ndcg, mrr, recall, latency_ms, error), rows with an error left out."""
    ok = F.col("error").isNull()
    def of_good(c: str) -> Column:
        return F.when(ok, F.col(c))

    means = rows.agg(
        F.count("*").alias("n_queries"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_errors"), *(mean(of_good(c)).alias(c) for c in ("ndcg", "mrr", "recall")), mean(of_good("latency_ms"), 1).alias("latency_mean")
    )
    at = exact_percentile(rows.filter(ok), "latency_ms", None, 0.5, 0.95).select(F.round("p50", 1).alias("latency_p50"), F.round("p95", 1).alias("latency_p95"))
    return means.crossJoin(at)  # one row each


def by_group(rows: DataFrame, group: str = "subject") -> DataFrame:
    good = rows.filter(F.col("error").isNull())
    return good.groupBy(group).agg(F.count("*").alias("n"), *(mean(F.col(c)).alias(c) for c in ("ndcg", "mrr", "recall"))).orderBy(group)


def groups_by_ndcg(groups: DataFrame, group: str = "subject") -> DataFrame:
    return groups.orderBy(F.desc("ndcg"), group)


def judged(seeds: DataFrame, citations: DataFrame, most: int = 50) -> DataFrame:
    """Relevance judgements of queries with a seed: the seed, and of the works that cite it the `most` cited ones. seeds:
    query_id, seed_doi; citations: cited_doi, citing_doi, cited_by_count. Ties go by DOI; a work counts once."""
    wanted = seeds.select("query_id", doi_key(text(F.col("seed_doi"))).alias("seed")).filter("seed <> ''").distinct()
    works = citations.select(doi_key(F.col("cited_doi")).alias("seed"), doi_key(F.col("citing_doi")).alias("doc_key"), "cited_by_count")
    # one row per work
    once = works.join(wanted.select("seed").distinct(), "seed", "left_semi").groupBy("seed", "doc_key").agg(F.max("cited_by_count").alias("n"))
    best = top_within(once, ["seed"], [F.desc_nulls_last("n"), F.asc("doc_key")], "doc_key", most).select("seed", "doc_key")
    cited = wanted.join(best, "seed").filter("doc_key <> ''").select("query_id", "doc_key")
    return wanted.select("query_id", F.col("seed").alias("doc_key")).unionByName(cited).distinct()
