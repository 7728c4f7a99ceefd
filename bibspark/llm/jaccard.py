"""Jaccard join of documents on word n-grams, and the groups that its links form.

The product of the document by n-gram incidence matrix with its transpose has the overlaps of all pairs. It is
computed in blocks of rows that may have links with each other, so that no pair outside a block is touched:

1. Two sets whose Jaccard similarity reaches the threshold differ in at most D n-grams, D from the size of the
   smaller one. Cut the n-grams by hash into D + 1 + c slices: then 1 + c slices at least are equal. Every set
   sends a hash of each slice for its own class of sizes and for the next smaller one; sets with an equal slice
   are joined to a block. The most frequent n-grams are left out of the slices, or a passage that many documents
   share would join them: what is left of two sets differs in D at most as well, so nothing is lost. Sets of which
   little is left send slices of all their n-grams too.
2. Sets are moved to their block once. There the product is accumulated over tiles of columns, rarest first: a
   matrix of overlap counts, one cell for each two rows, grows by the pairs of rows that share a column of few
   rows, and by a product of incidence matrices for columns of many. After each tile a pair is discarded when its
   sizes, or what is left of both rows' columns, can't reach the threshold; rows without a pair left go out. A group
   of copies gives counts in a matrix of a bounded number of rows, never a list of its pairs. Large blocks are mostly
   chains of sets that share a slice by chance; their sets are cut anew by other hashes, and only what is joined again
   stays together (see _refined). What is large then is cut to parts (see large_blocks).

Equal sets are found by hash first and enter as one row. Defined results: null and empty texts have the empty
set, 0 n-grams and no links; repeated rows give a row each. Rows without an id are documents like others: they can
link, and have no component_id if no document with an id is reachable (those with equal texts are repeated rows; where
there are any, ids have to be below 2^62). A text's length has no limit. Hashes have 64 bits (a slice or set hash 62).
`jaccard_groups` and `one_of_each` run jobs when they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, finished, fresh, groups, joined, materialize, mix64, ragged, shuffles_removed, span_hashes, word_spans

BYTES = 1_000_000
#: Slice hashes, and documents, that a task holds at once.
HELD, HELD_DOCS = 400_000, 50_000
#: N-grams that count as frequent, and how often one stands in what a task holds before it is counted.
FREQUENT, OFTEN = 50_000, 4
#: Rows and n-grams of a part of a block; blocks of more are cut to parts.
PART_ROWS, PART_GRAMS = 500, 500_000
#: Columns of a tile of the product, and pairs of rows that are counted at once.
TILE, ROOM = 2048, 500_000
#: Cells of a dense product that cost as much as one counted pair.
DENSE = 200
#: Pivots of a large block, and classes its rows are dealt by to meet them.
PIVOTS, SALTS = 12, 64
#: How often large blocks are cut anew at most.
ROUNDS = 2
SLICE, SAME, COPY = 0, 2, 3
EDGE = 1


def lower_bytes(buffer: np.ndarray) -> np.ndarray:
    """A-Z to lower case."""
    return np.where((buffer >= 65) & (buffer <= 90), buffer + np.uint8(32), buffer)


def shingle_sets(texts: list[str | None], words: int = 3) -> list[np.ndarray]:
    """The set of each text, as a sorted array of hashes: n-grams of words, or all words if they are fewer."""
    buffer, edges = joined(texts)
    buffer = lower_bytes(buffer)
    starts, ends = word_spans(buffer)
    h = span_hashes(buffer, starts, ends)
    first = np.searchsorted(starts, edges)
    grams = np.zeros(max(len(h) - words + 1, 0), U64)
    for k in range(words):
        grams = (grams ^ h[k : k + len(grams)]) * U64(0x9FB21C651E98DF25)
        grams ^= grams >> U64(32)
    grams = mix64(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            whole = U64(b - a)
            for x in h[a:b]:
                whole = mix64(np.array([whole ^ x]))[0]
            out.append(np.array([whole], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


class Slices:
    """Classes of set sizes and the hashes of slices."""

    def __init__(self, percent: int, frequent: np.ndarray | None = None):
        self.percent = percent
        self.frequent = np.zeros(0, U64) if frequent is None else frequent
        self.lows = [1]
        self.bounds: dict[int, np.ndarray] = {}

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, -(-self.lows[-1] * 100 // self.percent)))
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def slices(self, k: int) -> tuple[int, int]:
        """The number of slices in class k, and how many of them are equal at least: more than are empty by chance."""
        low, most = self.lows[k], self.lows[k + 1] - 1
        differ = most * (100 - self.percent) // self.percent
        about = 1.1 * differ + 1
        spare = min(3, differ) + int(np.ceil(2 * about * np.exp(-low / about))) if differ else 0
        return differ + 1 + spare, 1 + spare

    def _cut(self, s: np.ndarray, m: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the m slices of a sorted set, and which are filled. A slice's hash sums up its members'."""
        if m not in self.bounds:
            self.bounds[m] = np.array([(j << 64) // m for j in range(1, m)], U64)
        total = np.zeros(len(s) + 1, U64)
        np.cumsum(mix64(s + U64(0x51ED270B)), out=total[1:])
        at = np.concatenate([[0], np.searchsorted(s, self.bounds[m]), [len(s)]])
        key = mix64((total[at[1:]] - total[at[:-1]]) + mix64(np.arange(m).astype(U64) + U64(tag << 32)))
        return key, at[1:] > at[:-1]

    def hashes(self, s: np.ndarray) -> np.ndarray:
        """Slice hashes of one set for its own class and for the one below, in which it may be the larger partner.

        With few empty slices, one of the slices it shares with any partner is not empty. Otherwise that may hold for
        neither of two partners; then both send the slices of their whole sets, and empty ones if these are many too."""
        own = self.of(len(s))
        at = np.minimum(np.searchsorted(self.frequent, s), max(len(self.frequent) - 1, 0))
        light = s[self.frequent[at] != s] if len(self.frequent) else s
        out = []
        for k in (own, own - 1) if own else (own,):
            m, equal = self.slices(k)
            key, filled = self._cut(light, m, 2 * k)
            out.append(key[filled])
            if m - filled.sum() >= equal:
                key, filled = self._cut(s, m, 2 * k + 1)
                out.append(key if m - filled.sum() >= equal else key[filled])
        return np.concatenate(out)


def frequent_grams(docs: DataFrame, words: int, most: int) -> np.ndarray:
    """Hashes of the most frequent n-grams, sorted: at most `most`, a bound of what is sent to tasks. Which n-grams they
    are changes how much is compared, never the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some])], ["h", "n"])

        held, size = [], 0
        for batch in batches:
            for a, b in groups(batch.column(0), BYTES):
                held += shingle_sets(batch.column(0).slice(a, b - a).to_pylist(), words)
                size += sum(map(len, held[-(b - a) :]))
                if size > 5 * HELD:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    with shuffles_removed(docs.sparkSession):
        top = counts.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(U64))


def other_hashes(s: np.ndarray, seed: int) -> np.ndarray:
    """Sorted hashes anew, one to one: another seed deals n-grams to other slices. Seed 0 leaves them."""
    return np.sort(mix64(s ^ U64(seed * 0xA0761D6478BD642F % 2**64))) if seed else s


def _signatures(words: int, percent: int, frequent: np.ndarray, seed: int = 0):
    """Rows (key, a, b): a slice's key and a document; or, found within a batch, an edge between documents; or a
    document with its set's hash and size. The two low bits of the key tell the kind."""
    frequent = other_hashes(frequent, seed)

    def rows(ids: list[int], same: list[tuple[int, int]], slices: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        holder: dict[tuple[int, int], int] = {}
        for d, k in zip(ids, same, strict=True):
            holder[k] = min(d, holder.get(k, d))
        # a document is first of its set once; the same row again is a copy of itself
        left, first = set(holder), np.zeros(len(ids), bool)
        for i, (d, k) in enumerate(zip(ids, same, strict=True)):
            if k in left and holder[k] == d:
                left.discard(k)
                first[i] = True
        doc, size, h = np.array(ids), np.array([n for _, n in same]), np.array([x for x, _ in same], U64)
        head = np.array([holder[k] for k in same])
        own = (mix64(h) & ~U64(3)) | U64(SAME)
        other = (mix64(doc.astype(U64)) & ~U64(2**32 - 1)) | (size.astype(U64) << U64(2)) | U64(COPY)
        yield from _rows(np.where(first, own, other), doc, np.where(first, size, head))
        if not slices:
            return
        heads = np.array([holder[k] for k in slices])
        count = np.array([len(v) for v in slices.values()])
        key, at = np.concatenate(list(slices.values())) & ~U64(3), np.repeat(heads, count)
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        yield from _rows(key[new], at[new], None)
        lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        pairs = np.unique(np.stack([at, lead], 1)[at != lead], axis=0)
        if len(pairs):
            yield from _rows((mix64(pairs[:, 0].astype(U64)) & ~U64(3)) | U64(EDGE), pairs[:, 0], pairs[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Slices(percent, frequent)
        ids: list[int] = []
        same: list[tuple[int, int]] = []
        slices: dict[tuple[int, int], np.ndarray] = {}
        held = 0
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for a, b in groups(batch.column(1), BYTES):
                part = batch.slice(a, b - a)
                for doc, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), words), strict=True):
                    s = other_hashes(s, seed)
                    key = (int(mix64(s).sum(dtype=U64)) if len(s) else doc & (2**64 - 1), len(s))
                    ids.append(doc)
                    same.append(key)
                    if len(s) and key not in slices:
                        slices[key] = cut.hashes(s)
                        held += len(slices[key])
                if held > HELD or len(ids) > HELD_DOCS:  # what equal keys share is found within this much, and the rest after the shuffle
                    yield from rows(ids, same, slices)
                    ids, same, slices, held = [], [], {}, 0
        if ids:
            yield from rows(ids, same, slices)

    return run


def _rows(key: np.ndarray, a: np.ndarray, b: np.ndarray | None, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(key), most):
        k, x = pa.array(key[lo : lo + most].view(np.int64)), pa.array(a[lo : lo + most].astype(np.int64))
        y = pa.nulls(len(k), pa.int64()) if b is None else pa.array(b[lo : lo + most].astype(np.int64))
        yield pa.RecordBatch.from_arrays([k, x, y], ["key", "a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows in order of key and document. Gives documents (kind 0: a, the first document with its set b, size n;
    kind 1: the same, b only the first of its batch) and edges (kind 2: a, b)."""
    key_before, lead_before, size_before = None, 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        key, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        b = pa.compute.fill_null(batch.column(2), 0).to_numpy()
        kind = key & 3
        size = np.where(kind == SAME, b, -1)
        new = np.concatenate([[key_before is None or key[0] != key_before or size[0] != size_before], (key[1:] != key[:-1]) | (size[1:] != size[:-1])])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        lead = np.where(at >= 0, a[np.maximum(at, 0)], lead_before)
        key_before, lead_before, size_before = key[-1], lead[-1], size[-1]
        parts = []
        k = kind == SAME
        parts.append((np.zeros(k.sum(), np.int32), a[k], lead[k], b[k]))
        k = kind == COPY
        parts.append((np.ones(k.sum(), np.int32), a[k], b[k], (key[k] >> 2) & (2**30 - 1)))
        k = ((kind == SLICE) & (a != lead)) | (kind == EDGE)
        pairs = np.unique(np.stack([a[k], np.where(kind[k] == EDGE, b[k], lead[k])], 1), axis=0)
        parts.append((np.full(len(pairs), 2, np.int32), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)))
        cols = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, ["kind", "a", "b", "n"])


def components(edges: DataFrame) -> DataFrame:
    """The connected components of edges (a, b): node, component (its smallest node). Large-star and small-star in turn,
    each round written to the shared folder; counts and joins only, no collected edges."""

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        if small:
            both = both.filter("v < u")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = both.join(least, "u")
        if small:
            out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        else:
            out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        e = materialize(star(star(e, False), True))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = overlap(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def block_components(sets: list[np.ndarray], percent: int, room: int = ROOM, joined_before: list | None = None) -> np.ndarray:
    """Group labels of the sets of one block. room: pairs of rows counted at once; joined_before: a label per set, equal ones
    are known to be in one group."""
    k = len(sets)
    label = np.arange(k)
    if joined_before is not None:
        first: dict[object, int] = {}
        label = np.array([first.setdefault(g, i) for i, g in enumerate(joined_before)])
    return _spread(links(sets, percent, room), label)


def _spread(linked_rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest label that each row reaches by links and equal labels."""
    k = len(label)
    while True:
        least = np.minimum(label, np.where(linked_rows, label[None, :], k).min(1, initial=k))
        of_label = np.full(k, k)
        np.minimum.at(of_label, label, least)
        new = of_label[label]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def links(sets: list[np.ndarray], percent: int, room: int = ROOM) -> np.ndarray:
    """Which rows link with which, by the product of the block's incidence matrix with its transpose."""
    k = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    need = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))  # overlap of a link
    counts = np.zeros((k, k), np.int32)
    row, col, n_cols = _incidence(sets, size)
    edges = np.searchsorted(col, np.arange(0, n_cols + TILE, TILE))
    left = np.bincount(row, minlength=k)  # columns of each row that are still to come
    open_ = np.minimum(left[:, None], left[None, :]) >= need
    np.fill_diagonal(open_, False)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        going = open_.any(1)
        if not going.any():
            break
        some = going[row[a:b]]
        r, c = row[a:b][some], col[a:b][some]
        left -= np.bincount(row[a:b], minlength=k)
        _accumulate(counts, r, c, k, room)
        open_ &= counts + np.minimum(left[:, None], left[None, :]) >= need
    return open_


def _incidence(sets: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and columns of a block's incidence, in order of column, and the number of columns. Columns that one row has alone
    add nothing to any pair and are left out; the others are numbered by how many rows have them, fewest first."""
    flat = np.concatenate(sets)
    by_gram = np.argsort(flat)
    flat = flat[by_gram]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    deg = np.diff(np.append(starts, len(flat)))
    del flat
    row = np.repeat(np.arange(len(sets), dtype=np.int32), size)[by_gram]
    del by_gram
    shared = np.flatnonzero(deg > 1)
    shared = shared[np.argsort(deg[shared], kind="stable")]
    deg = deg[shared]
    return row[ragged(starts[shared], deg)], np.repeat(np.arange(len(deg), dtype=np.int32), deg), len(deg)


def _accumulate(counts: np.ndarray, r: np.ndarray, c: np.ndarray, k: int, room: int) -> None:
    """Adds a tile (rows r and columns c, in order of column) to the overlap counts."""
    if not len(r):
        return
    new = np.concatenate([[True], c[1:] != c[:-1]])
    deg = np.diff(np.append(np.flatnonzero(new), len(c)))
    rows, at = np.unique(r, return_inverse=True)
    n = len(rows)
    pairs = int((deg.astype(np.int64) ** 2).sum())
    if pairs * DENSE > n * n * len(deg):  # many rows to a column: a product of dense tiles is cheaper than counting pairs
        tile = np.zeros((n, len(deg)), np.float32)
        tile[at, np.cumsum(new) - 1] = 1
        counts[np.ix_(rows, rows)] += (tile @ tile.T).astype(np.int32)
        return
    starts = np.flatnonzero(new)
    total = np.cumsum(np.repeat(deg, deg))
    flat, lo = counts.reshape(-1), 0
    reach = np.repeat(starts, deg), np.repeat(deg, deg)
    while lo < len(r):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + room, side="right")))
        other = r[ragged(reach[0][lo:hi], reach[1][lo:hi])]
        cell, n_cell = np.unique(np.repeat(r[lo:hi].astype(np.int64), reach[1][lo:hi]) * k + other, return_counts=True)
        flat[cell] += n_cell.astype(np.int32)
        lo = hi


def _solve(percent: int):
    """Blocks stand in order within a partition; each is solved when its last row has come. Rows: block, rep, grams, label
    (null, or equal where rows are known to be in one group). Gives each rep and the smallest of its group."""

    def solve(docs, sets, labels):
        known = None if all(x is None for x in labels) else [d if x is None else ("l", x) for d, x in zip(docs, labels, strict=True)]
        label = block_components(sets, percent, joined_before=known)
        least: dict[int, int] = {}
        for d, g in zip(docs, label.tolist(), strict=True):
            least[g] = min(d, least.get(g, d))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([least[g] for g in label.tolist()], pa.int64())], ["rep", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, sets, labels = None, [], [], []
        for batch in batches:
            grams = batch.column(2)
            for k, (b, d, x) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)):
                if b != block and docs:
                    yield solve(docs, sets, labels)
                    docs, sets, labels = [], [], []
                block = b
                docs.append(d)
                sets.append(np.frombuffer(grams[k].as_buffer(), U64))
                labels.append(x)
        if docs:
            yield solve(docs, sets, labels)

    return run


def _blockwise(rows: DataFrame, percent: int) -> DataFrame:
    """Groups within blocks: rep, component."""
    ordered = rows.select("block", "rep", "grams", "label").repartition("block").sortWithinPartitions("block", "rep")
    return ordered.mapInArrow(_solve(percent), "rep long, component long")


def _pivot_links(percent: int):
    """Edges (a, b) from each row to the pivots of its block that it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column(1)[k].as_buffer(), U64)
                for p in batch.column(2)[k]:
                    other = np.frombuffer(p["grams"].as_buffer(), U64)
                    if linked(own, other, percent):
                        a.append(batch.column(0)[k].as_py())
                        b.append(p["rep"].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def large_blocks(rows: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Groups within blocks that are too large for one task: rep, component. rows: block, rep, grams; parts: block, k, the
    number of parts that it is cut to.

    A few pivots per block, one for each hash class, meet all its rows: most rows of a group of near copies link with one
    and are joined through it. Rows outside the largest group so found are then multiplied with all rows of the
    block, part by part: no task holds more than two parts, and no pair of rows in different groups is left out."""
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")
    pivots = rows.groupBy("block", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("c")).agg(F.min("rep").alias("rep")).select("block", "rep")
    lists = pivots.join(rows, ["block", "rep"]).groupBy("block").agg(F.collect_list(F.struct("rep", "grams")).alias("pivots"))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a merge join: compressed, the repeated pivots look small enough to be broadcast, and aren't
    met = rows.withColumn("salt", salt).join(lists.hint("merge"), ["block", "salt"]).select("rep", "grams", "pivots")
    stars = materialize(met.mapInArrow(_pivot_links(percent), "a long, b long"))
    found = components(stars)
    labelled = rows.select("block", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("block", "rep", F.coalesce("component", "rep").alias("label"))
    labelled = materialize(labelled)
    sums = labelled.groupBy("block", "label").agg(F.count("*").alias("n"))
    biggest = sums.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("big"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    plan = parts.join(biggest, "block").withColumn("outer_parts", F.ceil((F.col("rows") - F.col("most")) * F.col("k") / F.col("rows")).cast("int"))
    every = rows.join(labelled, ["block", "rep"]).join(plan.select("block", "k", "big", "outer_parts"), "block").filter("outer_parts > 0")
    h = F.xxhash64("rep", F.lit(1))
    inner = every.withColumn("i", F.pmod(h, F.col("k")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, outer_parts - 1)")))
    outer = every.filter("label <> big").withColumn("j", F.pmod(h, F.col("outer_parts")).cast("int")).withColumn("i", F.explode(F.expr("sequence(0, k - 1)")))
    both = inner.select("block", "i", "j", "rep", "grams", "label").unionByName(outer.select("block", "i", "j", "rep", "grams", "label"))
    tasks = both.select(F.xxhash64("block", "i", "j").alias("block"), "rep", "grams", "label")
    more = _blockwise(tasks, percent).select(F.col("rep").alias("a"), F.col("component").alias("b"))
    edges = more.unionByName(labelled.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    joined_up = components(edges)
    return rows.select("rep").join(joined_up.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in groups(batch.column(2), BYTES):
                part = batch.slice(a, b - a)
                raw = [s.tobytes() for s in shingle_sets(part.column(2).to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["block", "rep", "grams"])

    return run


def _keyed(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """_key and text of every row: the id, or for rows without one a number above all ids, from the text; and the largest id
    if there are such rows."""
    key = F.col("doc_id").cast("long")
    with shuffles_removed(docs.sparkSession):
        known = docs.agg(F.max(key), F.count(F.when(key.isNull(), 1))).first()
    if not known[1]:
        return docs.select(key.alias("_key"), "text"), None
    most = max(known[0] if known[0] is not None else 0, 0)
    if most >= 1 << 62:
        raise ValueError("rows without an id need ids below 2^62")
    return docs.select(_key(most).alias("_key"), "text"), most


def _key(most: int | None):
    key = F.col("doc_id").cast("long")
    return key if most is None else F.coalesce(key, F.lit(most + 1) + F.pmod(F.xxhash64("text"), F.lit(1 << 62)))


def _met(texts: DataFrame, words: int, percent: int, seed: int = 0) -> DataFrame:
    """What documents (two columns, key and text) with an equal slice give (see _meet)."""
    frequent = frequent_grams(texts, words, FREQUENT)
    signed = texts.mapInArrow(_signatures(words, percent, frequent, seed), "key long, a long, b long")
    return materialize(signed.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_meet, "kind int, a long, b long, n long"))


def _parts(blocks: DataFrame, of_size: DataFrame, part_rows: int, part_grams: int) -> DataFrame:
    """block, k (parts that it is cut to) and rows of blocks that are too large for one task."""
    sizes = blocks.join(of_size.withColumnRenamed("a", "_key"), "_key").groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    k = F.ceil(F.greatest(F.col("rows") / part_rows, F.col("n") / part_grams)).cast("int")
    return materialize(sizes.select("block", k.alias("k"), "rows").filter("k > 1"))


def _refined(texts: DataFrame, blocks: DataFrame, parts: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """The blocks (_key, block), those of `parts` cut anew.

    Sets that share a slice by chance are joined to chains, which grow faster than the table and cost the square of their
    rows. By other hashes, and with the n-grams that are frequent in these blocks left out, other sets meet by chance; two
    with a link meet whatever the hashes. So rows that aren't joined by both have no link, and nothing is lost."""
    large = materialize(blocks.join(parts.select("block"), "block", "left_semi"))
    met = _met(texts.join(large.select("_key"), "_key", "left_semi").select("_key", "text"), words, percent, seed)
    # all that met, equal sets too: a row's id may stand for several texts
    edges = met.filter("a <> b").select("a", "b").distinct()
    edges = edges.join(large.toDF("block_a", "a"), "a").join(large.toDF("block_b", "b"), "b").filter("block_a = block_b").select("a", "b")
    return materialize(blocks.join(parts.select("block"), "block", "left_anti").select("_key", "block").unionByName(components(edges).toDF("_key", "block")))


def _components(texts: DataFrame, words: int, percent: int, part_rows: int, part_grams: int) -> DataFrame:
    """_key, n (size of the set) and component (the smallest key reachable) of every row of _key and text."""
    met = _met(texts, words, percent)
    # documents that were first of their set in what a task held: few of each set, however many copies it has
    heads = met.filter("kind = 0").select("a", "b", "n")
    of = heads.groupBy("a", "n").agg(F.min("b").alias("b"))
    of_size = of.groupBy("a").agg(F.max("n").alias("n"))
    once = of.select("a", "b").distinct()
    edges = met.filter("kind = 2").select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = edges.join(once.toDF("x", "rx"), "x").join(once.toDF("y", "ry"), "y").select(F.col("rx").alias("a"), F.col("ry").alias("b"))
    blocks = materialize(components(edges).toDF("_key", "block"))
    parts = _parts(blocks, of_size, part_rows, part_grams)
    for seed in range(1, ROUNDS + 1):
        held = parts.agg(F.sum("rows")).first()[0]
        if not held:
            break
        blocks = _refined(texts, blocks, parts, words, percent, seed)
        parts = _parts(blocks, of_size, part_rows, part_grams)
        if 4 * (parts.agg(F.sum("rows")).first()[0] or 0) > 3 * held:  # groups of near copies, which stay together
            break
    # dealt by key at every size: the texts cross the network once, whatever share of them stands in blocks
    moved = texts.join(blocks.hint("merge"), "_key").select("block", F.col("_key").alias("rep"), "text")
    grams = materialize(moved.mapInArrow(_sets(words), "block long, rep long, grams binary"))
    parts = parts.select("block", "k")
    small = grams.join(parts, "block", "left_anti").withColumn("label", F.lit(None).cast("long"))
    solved = materialize(_blockwise(small, percent))
    if not parts.isEmpty():
        large = grams.join(parts.select("block"), "block", "left_semi")
        solved = solved.unionByName(materialize(large_blocks(large, parts, percent)))
    solved = solved.groupBy(F.col("rep").alias("b")).agg(F.min("component").alias("component"))
    # components go to the heads, and from each head to the copies that its task held: no key has many rows
    through = materialize(of.join(solved, "b", "left").select("a", "n", F.coalesce("component", "b").alias("component")))
    again = heads.groupBy("a", "n").count().join(through, ["a", "n"])  # repeated rows are rows each
    first = again.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    copies = met.filter("kind = 1").select("a", F.col("b").alias("head"), "n")
    rest = copies.join(through.withColumnRenamed("a", "head"), ["head", "n"])
    out = first.select("a", "n", "component").unionByName(rest.select("a", "n", "component"))
    return out.withColumnRenamed("a", "_key")


def jaccard_groups(docs: DataFrame, words: int = 3, percent: int = 90, part_rows: int = PART_ROWS, part_grams: int = PART_GRAMS) -> DataFrame:
    """doc_id, n_shingles (size of its set) and component_id (smallest doc_id reachable by links), one row per row."""
    texts, most = _keyed(docs)
    found = finished(docs.sparkSession, lambda: _components(texts, words, percent, part_rows, part_grams))
    if most is None:
        return found.toDF("doc_id", "n_shingles", "component_id")
    own, component = F.when(F.col("_key") <= most, F.col("_key")), F.when(F.col("component") <= most, F.col("component"))
    return found.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """One row of each group: that with the smallest id, or with none if no row of the group has an id. Of equal rows, one is
    left; rows with one id but different texts aren't told apart by it, and all stay."""
    texts, most = _keyed(docs)
    found = finished(docs.sparkSession, lambda: _components(texts, words, percent, PART_ROWS, PART_GRAMS))
    name = fresh(docs, "_key")
    first = materialize(found.filter("_key = component").groupBy(F.col("_key").alias(name)).agg((F.count("*") > 1).alias("again")))
    keyed = docs.withColumn(name, _key(most))
    # both joins read one exchange of the documents, dealt alike at every size
    once = keyed.join(first.filter("NOT again").hint("merge"), name, "left_semi")
    # rows with one id are rare: only they are gathered by id
    again = keyed.join(first.filter("again").hint("merge"), name, "left_semi").dropDuplicates([name, "text"])
    return once.unionByName(again).select(docs.columns)
