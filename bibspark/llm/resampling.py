"""Quality classifier by importance resampling.

Texts are split to runs of word characters and runs of other visible characters; single tokens and pairs of
neighbours are hashed to buckets. Two generative models, bags of these n-grams, are counted: one over the target
texts (labelled good), one over all documents. The ratio of a document's likelihoods is a product over its n-grams, so
its logarithm grows with the length and dwarfs any noise: the sample would be a plain cut. It is therefore tempered: a
document's log weight is the mean of the logarithm per n-gram times LENGTH, the ratio of a text of that many n-grams,
whatever its own length (a temperature of its number of n-grams by LENGTH). Gumbel noise is added to the log weight, and
the k largest sums are kept: a sample without replacement in proportion to the tempered weights. The smaller LENGTH, the
more the noise decides.

Defined results: null and empty texts have no n-grams, weight 0 in logarithm. Ties are broken by doc_id, repeated rows
have equal noise and are ranked one after another. Without labels of the target, all weights are 0 and nothing is
dropped. Noise depends on the id, the text and the seed only: reruns agree. `resample` runs jobs when it is called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import lower_bytes
from .ranking import rank_within
from .shared import U64, groups, joined, mix64, span_hashes, sums_between

BUCKETS = 1 << 14
#: Labelled target rows used at most, those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: N-grams that a weight stands for.
LENGTH = 32.0
SMOOTH = 1.0
BYTES = 1_000_000


def _kinds() -> np.ndarray:
    """0 for white space and control characters, 1 for letters, digits and all bytes beyond ASCII, 2 for the rest."""
    kind = np.full(256, 2, np.uint8)
    kind[:33] = 0
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        kind[ord(a) : ord(b) + 1] = 1
    kind[128:] = 1
    return kind


_KIND = _kinds()


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of texts one after another, and the edges between texts."""
    buffer, edges = joined(texts)
    buffer = lower_bytes(buffer)
    kind = _KIND[buffer]
    new = np.concatenate([[True], kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(buffer))
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    h = span_hashes(buffer, starts, ends, seed=5)
    first = np.searchsorted(starts, edges)
    pair = mix64(h[:-1] * U64(3) ^ h[1:]) if len(h) > 1 else h[:0]
    inside = np.ones(len(pair), bool)
    cut = first[1:-1]
    inside[cut[(cut > 0) & (cut <= len(pair))] - 1] = False
    shift = U64(64 - BUCKETS.bit_length() + 1)
    one = (h >> shift).astype(np.int64)
    two = (pair[inside] >> shift).astype(np.int64)
    n_two = sums_between(inside, np.minimum(first, len(pair)))
    n_one = np.diff(first)
    out = np.empty(len(one) + len(two), np.int64)
    counts = n_one + n_two
    at = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), n_one)
    out[at[owner] + np.arange(len(one)) - first[owner]] = one
    owner2 = np.repeat(np.arange(len(texts)), n_two)
    before = np.concatenate([[0], np.cumsum(n_two)])
    out[at[owner2] + n_one[owner2] + np.arange(len(two)) - before[owner2]] = two
    return out, at


def count(docs: DataFrame) -> np.ndarray:
    """Counts of the buckets over all texts. Every task sends one row per bucket, and their number is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b in groups(batch.column(0), BYTES):
                total += np.bincount(buckets(batch.column(0).slice(a, b - a).to_pylist())[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for r in rows.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)

    def log_p(c):
        return np.log(c + SMOOTH) - np.log(c.sum() + SMOOTH * BUCKETS)

    return log_p(target) - log_p(raw)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, n_grams, log_weight and gumbel (log weight and noise) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in groups(batch.column(1), BYTES):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                grams, at = buckets(texts)
                total = np.concatenate([[0.0], np.cumsum(ratio[grams])])
                n = np.diff(at)
                weight = LENGTH * (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
                # summed within the batch; rounded so that the result doesn't hang on what stands before a text
                weight = np.round(weight, 6)
                buffer, edges = joined(texts)
                h = span_hashes(buffer, edges[:-1], edges[1:] - 1, seed=6)
                ids = np.array([0 if d is None else d for d in part.column(0).to_pylist()], np.int64)
                h = mix64(h ^ mix64(ids.astype(U64) + U64(seed)))
                uniform = ((h >> U64(11)).astype(float) + 0.5) / (1 << 53)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(weight), pa.array(weight - np.log(-np.log(uniform)))], ["doc_id", "n_grams", "log_weight", "gumbel"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double, gumbel double")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0) -> DataFrame:
    """Every row's doc_id, n_grams, log_weight, gumbel and kept. share: of all rows, to keep; by default the share of good
    documents among the labelled ones."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    some = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    target = count(docs.join(F.broadcast(some), "doc_id", "left_semi"))  # MAX_LABELLED ids at most
    if share is None:
        share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        share = 1.0 if share is None or not target.sum() else share
    weighed = weigh(docs, log_ratio(target, count(docs)), seed)
    order = [F.col("gumbel").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = rank_within(weighed, None, order)
    k = int(-(-share * docs.count() // 1))
    return ranked.select("doc_id", "n_grams", "log_weight", "gumbel", (F.col("rank") <= k).alias("kept"))
