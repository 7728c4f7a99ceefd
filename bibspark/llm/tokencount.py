"""Exact token counts by a compiled finite-state transducer.

The border rule of the byte-level tokenizer is compiled to a deterministic transducer over classes of
characters; its transitions are annotated with what they emit: a border here, or a border one character back.
Every chunk of a batch gives a map from entering state to leaving state and the number of borders emitted, all
chunks advancing together; the maps compose by a parallel prefix scan, which tells each chunk its entering state
and the number of its first border. A second pass writes the borders to their places. Between two borders stands
one word; the transducer's word transitions emit its token count, which is compiled on first use (see bpe.py) and
kept. A file whose settings differ from the compiled ones is refused.

Null and empty texts count 0 tokens. Texts of any length are read whole: long ones are cut only before a space
after a word, where the transducer is in the same state whatever came before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from .bpe import Memo, Merges
from .shared import groups, ragged, span_hashes, sums_between

# Classes of characters.
LETTER, NUMBER, SPACE, WHITE, OTHER, APOSTROPHE, STMD, R, V, E, L, END = range(12)
_LETTERS = (LETTER, STMD, R, V, E, L)
# States: at a border that is sure; in a run of letters, numbers or others; after one space or other white
# character; after several, the last a space or not; after an apostrophe that opens a word, and after one and
# "r" or "v", or "l".
START, IN_L, IN_N, IN_O, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, AP, AP_RV, AP_L = range(11)
STATES = 11
HERE, BACK = 1, 2
CHUNK = 128


def _open(c: int) -> int:
    """The state after a character that opens a word."""
    return {NUMBER: IN_N, SPACE: ONE_SPACE, WHITE: ONE_WHITE, OTHER: IN_O, APOSTROPHE: AP, END: START}.get(c, IN_L)


def _move(s: int, c: int) -> tuple[int, int]:
    """The next state and what the transition emits."""
    if c == END:
        return START, HERE | (BACK if s in (AP_RV, AP_L) else 0)
    white = c in (SPACE, WHITE)
    if s in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        if white:
            return (RUN_SPACE if c == SPACE else RUN_WHITE), 0
        if s == ONE_SPACE or s == RUN_SPACE:  # the space belongs to what follows
            return (IN_O if c == APOSTROPHE else _open(c)), (BACK if s == RUN_SPACE else 0)
        return _open(c), HERE | (BACK if s == RUN_WHITE else 0)
    if s == AP:
        if c == STMD:
            return START, 0
        if c in (R, V):
            return AP_RV, 0
        if c == L:
            return AP_L, 0
        return (IN_O, 0) if c in (OTHER, APOSTROPHE) else (_open(c), HERE)
    if s == AP_RV and c == E or s == AP_L and c == L:
        return START, 0
    if s in (AP_RV, AP_L):  # no contraction: letters began one character back
        then, emits = _move(IN_L, c)
        return then, emits | BACK
    same = s == IN_L and c in _LETTERS or s == IN_N and c == NUMBER or s == IN_O and c in (OTHER, APOSTROPHE)
    return (s, 0) if same else (_open(c), HERE)


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and emissions, indexed by 16 * state + class."""
    to, emits = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for s in range(STATES):
        for c in range(12):
            to[16 * s + c], emits[16 * s + c] = _move(s, c)
    return to, emits


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            for part in regex.finditer(r"[\0-퟿]+|[-\U0010FFFF]+", m[0]):
                a = ord(part[0][0])
                out[a : a + len(part[0])] = kind
    for kind, chars in ((SPACE, " "), (APOSTROPHE, "'"), (STMD, "stmd"), (R, "r"), (V, "v"), (E, "e"), (L, "l")):
        for ch in chars:
            out[ord(ch)] = kind
    return out


def borders(classes: np.ndarray) -> np.ndarray:
    """Positions where a word (or an end) starts, in a stream of texts with an END after each.

    A chunk's map gives, for each state it may be entered in, the state it is left in and how many borders it emits. The
    maps compose by an inclusive prefix scan: states through the map, counts by addition. So each chunk learns its entering
    state and the number of its first border, and all chunks write their borders to their places at once."""
    to, emits = _machine()
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)
    sums = np.zeros((STATES, rows), np.int64)
    weigh = (emits & HERE).astype(np.int64) + (emits & BACK > 0)
    for t in range(CHUNK):
        at = (maps << 4) | grid[t]
        sums += weigh[at]
        maps = to[at]
    step = 1
    while step < rows:
        through = maps[:, :-step].astype(np.intp)
        sums = np.concatenate([sums[:, :step], sums[:, :-step] + np.take_along_axis(sums[:, step:], through, axis=0)], axis=1)
        maps = np.concatenate([maps[:, :step], np.take_along_axis(maps[:, step:], through, axis=0)], axis=1)
        step *= 2
    state = np.concatenate([[np.uint8(START)], maps[START, :-1]]).astype(np.uint8)
    place = np.concatenate([[0], sums[START, :-1]])
    out = np.empty(int(sums[START, -1]) if rows else 0, np.int64)
    first = np.arange(rows) * CHUNK
    for t in range(CHUNK):
        at = (state << 4) | grid[t]
        mark, state = emits[at], to[at]
        for bit, position in ((BACK, first + t - 1), (HERE, first + t)):
            some = np.flatnonzero(mark & bit)
            out[place[some]] = position[some]
            place[some] += 1
    return out[out < n]


@lru_cache(2)
def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The settings of a tokenizer file that the compiled rules hold for.
SETTINGS = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
BORDERS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _known(spec: dict) -> None:
    """Raises an error for a file with other rules than the compiled ones: it would be miscounted."""
    model, borders = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [f"model.{k}" for k, v in SETTINGS.items() if (model.get(k) or None) != (v or None)]
    wrong += [f"pre_tokenizer.{k}" for k, v in BORDERS.items() if borders.get(k) != v]
    wrong += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
    wrong += [f"added_tokens.{k}" for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if wrong:
        raise ValueError(f"no compiled rules for these settings of the tokenizer: {', '.join(wrong)}")


class Counter:
    """A compiled tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        _known(spec)
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        rank = {a + b: i for i, (a, b) in enumerate(merges)}
        rows = [(tuple(alphabet[c] for c in p), i, rank.get(p, -1)) for p, i in vocab.items() if p not in self.special]
        self.bpe = Merges(*map(list, zip(*rows, strict=True)), size=max(vocab.values()) + 1)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo = Memo()

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Token counts of texts."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.split and any(s in text for s in self.special):
                parts = self.split.split(text)
                extra[i] = len(parts) - 1
            for part in parts:
                for piece in cut(part):
                    pieces.append(piece)
                    owner.append(i)
        if not pieces:
            return extra
        total, lo, held = extra, 0, 0
        for k, piece in enumerate([*pieces, ""]):
            if k == len(pieces) or held and held + len(piece) > LIMIT:
                total += np.bincount(owner[lo:k], self._count(pieces[lo:k]), len(texts)).astype(np.int64)
                lo, held = k, 0
            held += len(piece)
        return total

    def _count(self, pieces: list[str]) -> np.ndarray:
        points = np.frombuffer("\0".join([*pieces, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        classes = _classes()[points]
        classes[ends] = END
        starts = borders(classes)
        word = classes[starts] != END
        stops = np.append(starts[1:], len(points))[word]
        starts = starts[word]
        h = span_hashes(points, starts, stops)
        found = self.memo.get(h)[0]
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            a, n = starts[miss[first]], (stops - starts)[miss[first]]
            counts = self._words(points[ragged(a, n)], n)
            found[miss] = counts[back]
            self.memo.put(new, counts)
        return sums_between(found, np.concatenate([[0], np.searchsorted(starts, ends)]))

    def _words(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        units = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.uint32)
        wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        size = sums_between(wide, np.concatenate([[0], np.cumsum(lengths)]))
        return self.bpe.encode(units, np.cumsum(size) - size, size)[0]


LIMIT = 1_000_000


def cut(text: str, limit: int = LIMIT) -> Iterator[str]:
    """Parts of about `limit` characters, cut before a single space that follows a word character: there a word
    starts in any state."""
    at = 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


_SAFE = regex.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text. No shuffle: one pass over the table.

    Null and empty texts have 0 bytes and tokens. Repeated rows are counted one by one; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for a, b in groups(batch.column(1), LIMIT):
                part = batch.slice(a, b - a)
                texts = part.column(1)
                n = pa.array(c.count(texts.to_pylist()))
                size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n, pa.compute.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
