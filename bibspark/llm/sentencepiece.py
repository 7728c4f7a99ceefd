"""Encoding texts with a SentencePiece BPE model, and decoding ids, in numpy.

A text is a stream of words, each with the spaces before it. Words met for the first time are encoded by the
batched programme of bpe.py (all words advance together; substring hashes probe the sorted keys of the pieces;
the backpointers give the pieces). A plain Viterbi search for the best sum of scores does not give a BPE
model's ids, so a piece is admitted only where the order of merges allows it; one path is then left, the
library's. Characters without a piece fall back to byte pieces. Equal words are encoded once per worker.

Null and empty texts give no ids. Decoding gives back the text exactly, except that the model's own word
separator inside a text comes back as a space (as in the library).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Memo, Merges
from .shared import groups, ragged, span_hashes, sums_between
from .tokencount import cut

MARK = 0x2581
LIMIT = 1_000_000
#: Ids kept for known words by one worker, before it starts anew.
POOL = 8_000_000


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.GetPieceSize()
        names = [model.IdToPiece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i))]
        inner = chr(MARK)
        assert not any(inner in names[i].lstrip(inner) for i in plain), "a piece goes on over a word's start"
        self.bytes = np.zeros(256, np.int64)
        text_of: list[bytes] = [b""] * n
        for i in range(n):
            if model.IsByte(i):
                self.bytes[int(names[i][3:5], 16)] = i
                text_of[i] = bytes([int(names[i][3:5], 16)])
            elif not (model.IsControl(i) or model.IsUnknown(i)):
                text_of[i] = names[i].replace(inner, " ").encode()
        self.bpe = Merges([tuple(map(ord, names[i])) for i in plain], plain, [-int(model.GetScore(i)) for i in plain], size=n)
        self.size = n
        self.texts = np.frombuffer(b"".join(text_of), np.uint8)
        lengths = np.array(list(map(len, text_of)), np.int64)
        self.text_at, self.text_n = np.cumsum(lengths) - lengths, lengths
        self._forget()

    def _forget(self) -> None:
        self.memo, self.held = Memo(numbers=2), 0
        self.flat = np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the edges between texts."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for piece in cut(" " + text) if text else ():
                pieces.append(piece)
                owner.append(i)
        ids, counts = [], np.zeros(len(texts), np.int64)
        lo, held = 0, 0
        for k, piece in enumerate([*pieces, ""]):
            if k == len(pieces) or held and held + len(piece) > LIMIT:
                if k > lo:
                    some, n = self._encode(pieces[lo:k])
                    ids.append(some)
                    np.add.at(counts, owner[lo:k], n)
                lo, held = k, 0
            held += len(piece)
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(counts)])

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).copy()
        points[points == 32] = MARK
        edges = np.concatenate([[0], np.cumsum(list(map(len, pieces)))])
        mark = points == MARK
        start = mark & ~np.concatenate([[False], mark[:-1]])
        start[edges[:-1]] = True
        starts = np.flatnonzero(start)
        stops = np.append(starts[1:], len(points))
        h = span_hashes(points, starts, stops, seed=2)
        if self.held > POOL:
            self._forget()
        at, n = self.memo.get(h)  # where the ids of a word start in the pool, and how many there are
        miss = np.flatnonzero(at < 0)
        fresh = np.zeros(0, np.int32)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            a, size = starts[miss[first]], (stops - starts)[miss[first]]
            counts, flat = self._words(points[ragged(a, size)].astype(np.uint32), size)
            place = self.held + np.cumsum(counts) - counts
            at[miss], n[miss] = place[back], counts[back]
            fresh = flat.astype(np.int32)
            self.held += len(fresh)
            small = counts < 1 << 10
            self.memo.put(new[small], place[small], counts[small])
        if len(fresh):
            self._add(fresh)
        ids = self.flat[ragged(at, n)]
        return ids, sums_between(n, np.searchsorted(starts, edges))

    def _add(self, fresh: np.ndarray) -> None:
        """The pool grows by doubling."""
        before = self.held - len(fresh)
        if self.held > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.held, 1 << 16), np.int32)
            grown[:before] = self.flat[:before]
            self.flat = grown
        self.flat[before : self.held] = fresh

    def _words(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = self.bpe.encode(points, np.cumsum(lengths) - lengths, lengths)
        odd = ids >= self.size
        if not odd.any():
            return counts, ids
        raw = [chr(i - self.size).encode() if o else b"" for i, o in zip(ids.tolist(), odd.tolist(), strict=True)]
        size = np.where(odd, np.array(list(map(len, raw))), 1)
        out = np.repeat(ids, size)
        out[np.repeat(odd, size)] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return sums_between(size, np.concatenate([[0], np.cumsum(counts)])), out

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts whose ids stand between the edges."""
        n = self.text_n[ids]
        flat = self.texts[ragged(self.text_at[ids], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[edges]
        # the first piece carries the separator that encoding puts before every text
        return [flat[a + (b > a and flat[a] == 32) : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _map(docs: DataFrame, run, id_col: str, columns: str, extra: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[extra].alias("value")).mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ids (array<int>) and n_pieces (long) of every row, repeated rows included. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a, b in groups(batch.column(1), LIMIT):
                part = batch.slice(a, b - a)
                ids, edges = c.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(edges))], ["id", "ids", "n_pieces"])

    return _map(docs, run, id_col, "ids array<int>, n_pieces long", text_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and the text of every row of ids. Null ids give an empty text; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = [np.array(x or [], np.int64) for x in part.column(1).to_pylist()]
                texts = c.decode(np.concatenate(lists), np.concatenate([[0], np.cumsum(list(map(len, lists)))]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode("utf-8", "replace") for t in texts])], ["id", "text"])

    return _map(encoded, run, id_col, "text string", ids_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text in one pass, and returns digests: n_bytes and n_pieces (long), ids_sha256
    of the ids as little-endian 32-bit integers, text_sha256 of the decoded text, and exact (decoded == text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a, b in groups(batch.column(1), LIMIT):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                ids, edges = c.encode(texts)
                back = c.decode(ids, edges)
                raw, ends = ids.astype("<i4").tobytes(), (4 * edges).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t) for t in back], pa.int64()),
                        pa.array(np.diff(edges)),
                        pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)]),
                        pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                        pa.array([(t or "").encode() == d for t, d in zip(texts, back, strict=True)]),
                    ],
                    ["id", "n_bytes", "n_pieces", "ids_sha256", "text_sha256", "exact"],
                )

    return _map(docs, run, id_col, "n_bytes long, n_pieces long, ids_sha256 string, text_sha256 string, exact boolean", text_col)
