"""Helpers that several corpus operators share: tables, the shared folder, batches and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cleanup, shared_path, shared_root  # noqa: F401  tables and results lie below one folder, which cleanup removes

#: White space between words: space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lists of the paths made, of all `scratch` blocks that are open in this thread.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (see session.shared_root)."""
    path = shared_path(spark)
    for made in _open.get():
        made.append(path)
    return path


#: Spark's setting by which a query's shuffle files go when it ends. Without it they stay until the driver collects its
#: garbage, which long jobs of few objects seldom make it do: then all shuffles of an operator lie on disk at once.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that runs inside are removed as it ends."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors, and gives
    Catalyst the true size, so that it broadcasts only what is below its threshold. What was shuffled for it is removed."""
    path = shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _finished(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        with shuffles_removed(spark):
            out = materialize(make())
    finally:
        _open.reset(token)
    # the last path made is the table's own
    remove(spark, made[:-1])
    return out, made[-1]


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that `make` gives, written; all that was written on the way to it is removed."""
    return _finished(spark, make)[0]


def chain(docs: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The result of steps on documents, each written and read again as the next one's input; what a step wrote on its way,
    and its input, are removed when its result is written."""
    before: list[str] = []
    for step in steps:
        docs, path = _finished(docs.sparkSession, lambda step=step, docs=docs: step(docs))
        remove(docs.sparkSession, before)
        before = [path]
    return docs


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def word_count(text) -> F.Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def groups(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text each, and one row at least."""
    if not len(texts):
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables grow by doubling and are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < n:
            have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of an integer array: equal spans have equal hashes wherever they stand."""
    n = len(units)
    if not len(starts):
        return np.zeros(0, U64)
    sums = np.zeros(n + 1, U64)
    each = mix64(np.arange(256, dtype=U64) + U64(0x1000193 + seed))[units] if units.dtype == np.uint8 else mix64(units.astype(U64) + U64(0x1000193 + seed))
    np.cumsum(each * powers(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each span, one span after another."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def sums_between(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[i]:edges[i + 1]]; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def joined(texts: Iterable[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts with one line feed after each, and the edge before each text (and after the last)."""
    raw = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])]).astype(np.int64)
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), edges
