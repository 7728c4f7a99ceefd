"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) weigh 5, 2, 1, 5, ... and share all words of the corpus; a target above 3
times its source's size stops there, and the excess is shared by weight again until no target is above. That fixed
point is found at once: in order of size per weight, a source is full as long as its cap is below its share of
what the full ones leave.

A source's rate is its target by its size. The expected copies of its documents are summed up in a fixed order, one
random offset is added, and a document is taken once per integer crossed. In a small source a few long documents
make much of a difference, so several systematic samples are drawn, each with an order and an offset of its own, and
the one whose words come nearest to the target counts. The orders are strides through the ranking by size (the first
is that ranking, in which long and short documents are taken evenly), so only one ranking is made; the offsets are
hashes of seed, draw and source.

Defined results: null and empty texts have size 0; they are emitted like others but add no words; a source without
words has target 0 and is not taken. Null is a source of its own. Ties are ordered by doc_id; repeated rows are
sampled one by one. Reruns give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import rank_within, sums_before
from .shared import fresh, materialize, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
DRAWS = 48
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size and target of each source, from rows with source and size.

    A corpus may have a source per host: sources are ranked and summed up in parts, never ordered in one task."""
    big = "decimal(38,0)"
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.col("rank") - 1) % len(weights)
    s = rank_within(s, None, [F.col("source").asc_nulls_last()]).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long")).drop("rank")
    s = s.withColumn("cap", (most * F.col("source_size")).cast("long"))
    order = [F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last()]
    s = sums_before(s, order, {"cap_before": "cap", "w_before": "w", "size_before": "source_size"})
    s = s.withColumn("left", F.col("all_size_before") - F.col("cap_before")).withColumn("wide", F.col("all_w_before") - F.col("w_before"))
    s = s.withColumn("full", F.col("cap").cast(big) * F.col("wide").cast(big) < F.col("w").cast(big) * F.col("left").cast(big))
    # one number for all: what the sources that aren't full share by weight
    level = s.filter(~F.col("full")).agg(F.max(F.col("left").cast("double") / F.col("wide").cast("double")).alias("level"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return s.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))  # level is one row


def offset(source: Column, draw: Column, seed: str) -> Column:
    """A number in [0, 1) for each source and draw."""
    named = F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / 4294967296.0


def strides(n: int = DRAWS) -> list[int]:
    """1 and the first primes above a million: a source whose number of documents isn't a multiple is walked through once."""
    out, p = [1], 1_000_001
    while len(out) < n:
        if all(p % d for d in range(3, 1001, 2)):
            out.append(p)
        p += 2
    return out


def _place(rank: Column, n: Column, stride: Column) -> Column:
    """The place of a rank in a stride's order."""
    return F.when(n % stride == 0, rank).otherwise((rank - 1) * stride % n + 1)


def _crossed(rate: Column, rank: Column, u: Column) -> Column:
    """Integers between the sums of expected copies before and after a document."""
    return F.least(F.floor(rate * rank + u) - F.floor(rate * (rank - 1) + u), F.lit(MOST_COPIES)).cast("long")


def copies(docs: DataFrame, keep: list[str] = (), seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies * size) of every row, and the columns of `keep`.

    One pass over the texts leaves ids and sizes; only these are shuffled."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep))
    ranked = rank_within(sizes, "source", [F.col("size").asc(), F.col("doc_id").asc_nulls_last()])
    share = targets(sizes).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    share = share.withColumn("u", F.array(*[offset(F.col("source"), F.lit(j), seed) for j in range(DRAWS)])).withColumnRenamed("source", "_source")
    count = sizes.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n_docs"))
    share = materialize(share.join(count, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"))
    rows = ranked.join(share, F.col("source").eqNullSafe(F.col("_source")), "left")

    def taken(u: Column, stride: Column) -> Column:
        return _crossed(F.col("rate"), _place(F.col("rank"), F.col("n_docs"), stride), u)

    # a sum per draw and source, made before the shuffle
    sums = rows.groupBy("_source", "target", "u").agg(*[F.sum(taken(F.get("u", F.lit(j)), F.lit(a)) * F.col("size")).alias(f"t{j}") for j, a in enumerate(strides())])
    draws = F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("off"), F.lit(j).alias("draw")) for j in range(DRAWS)])
    best = F.array_min(draws)["draw"]
    chosen = materialize(sums.select(F.col("_source").alias("_best"), F.get("u", best).alias("offset"), F.get(F.array(*map(F.lit, strides())), best).cast("long").alias("stride")))
    out = rows.join(chosen, F.col("_source").eqNullSafe(F.col("_best")), "left")
    n = taken(F.col("offset"), F.col("stride"))
    return out.select("doc_id", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"), *keep)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row of documents as many times as it is taken."""
    row, n, rows, copy = (fresh(docs, c) for c in ("_row", "_copies", "_rows", "_copy"))
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "source", "text"))
    taken = copies(keyed, [row], seed).groupBy(row).agg(F.sum("copies").alias(n), F.count("*").alias(rows))
    taken = materialize(taken.filter(F.col(n) > 0))
    taken = taken.hint("merge")  # dealt alike at every size
    once = keyed.join(taken.filter(F.col(rows) == 1), row)
    # rows that stand in the table twice share their copies; they are rare
    again = keyed.join(taken.filter(F.col(rows) > 1), row).dropDuplicates([row])
    both = once.unionByName(again)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *,
    (SELECT sum(source_size) FROM w)::HUGEINT - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS rest,
    (SELECT sum(w) FROM w)::HUGEINT - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS wide FROM w),
f AS (SELECT *, cap::HUGEINT * wide < w::HUGEINT * rest AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE w * (SELECT max(rest::DOUBLE / wide::DOUBLE) FROM f WHERE NOT is_full) END AS target FROM f),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS rank, count(*) OVER (PARTITION BY d.source) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
a AS (SELECT unnest(range(len(x))) AS j, unnest(x) AS stride FROM (SELECT @STRIDES::BIGINT[] AS x)),
u AS (SELECT source, j, stride, ('0x' || substr(md5('mix:' || j || ':' || coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, a),
k AS (SELECT r.*, j, u, CASE WHEN n % stride = 0 THEN rank ELSE (rank - 1) * stride % n + 1 END AS k FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source),
c AS (SELECT *, least(floor(rate * k + u) - floor(rate * (k - 1) + u), 3)::BIGINT AS copies FROM k),
b AS (SELECT source, arg_min(j, (abs(taken - target), j)) AS j FROM (SELECT source, j, target, sum(copies * size) AS taken FROM c GROUP BY ALL) GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target, c.copies, c.copies * c.size AS taken FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.j = b.j
""".replace("@STRIDES", str(strides()))
