"""Byte-pair encoding as a dynamic programme in numpy.

The encoding of a prefix ends in exactly one token. That token is the one that the vocabulary holds and that
may stand after the last token of what precedes it; a pair of tokens may stand side by side if no merge
across their border would have come first. So all words advance by one unit together: substring hashes probe
the sorted keys of the pieces, the pair test picks the one that fits, and its length is stored as backpointer.
The result is that of merging by rank, without a priority queue per word.

Words of any length go the same way. A long one is cut to chunks that advance together, each from a few units before
its own, as if a word began there: what a prefix ends in hangs on the last few tokens only, so a chunk whose tokens
agree with its neighbour's over the longest piece's length before its first unit has found the word's own. The others
advance again from their neighbour's tokens, until all agree.
"""

from __future__ import annotations

import numpy as np

from .shared import U64, mix64, powers, ragged

NONE = np.int32(-1)
_STEP = 0xC2B2AE3D27D4EB4F
#: Cells (words by units) that advance at once.
CELLS = 500_000
#: Units of a chunk for each unit before it.
STRETCH = 4
#: Rounds in which all chunks that disagree advance again together; then one after another, equal ones once.
ROUNDS = 2


class Merges:
    """A vocabulary: units (bytes or code points) of each piece, and the rank that orders merges.

    Units outside the vocabulary stand alone: unit u gets the id `size + u`."""

    def __init__(self, pieces: list[tuple[int, ...]], ids: list[int], ranks: list[int], size: int):
        self.size = size
        self.longest = max(map(len, pieces))
        self.of = dict(zip(pieces, ids, strict=True))
        top = max(ids) + 1
        self.rank = np.full(top, -1, np.int64)
        for p, i, r in zip(pieces, ids, ranks, strict=True):
            if len(p) > 1:
                self.rank[i] = r
        self.single = {p[0]: i for p, i in zip(pieces, ids, strict=True) if len(p) == 1}
        self.keys, self.values = self._hashed(pieces, ids)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.keys >> U64(42)] = True
        self.left, self.right = self._splits(pieces, ids)
        self.pair_keys, self.pair_ids = self._pairs(pieces, ids)
        self.by_length = sorted({len(p) for p in pieces}, reverse=True)
        self.slots = 1 << 20
        self.seen = np.full(self.slots, U64(2**64 - 1))
        self.fits_there = np.zeros(self.slots, bool)

    @staticmethod
    def _prefix(units: np.ndarray) -> np.ndarray:
        """Rolling hashes of the prefixes of each row."""
        out = np.zeros((len(units), units.shape[1] + 1), U64)
        v = mix64(units.astype(U64) + U64(77))
        for i in range(units.shape[1]):
            out[:, i + 1] = out[:, i] * U64(_STEP) + v[:, i]
        return out

    def _hashed(self, pieces, ids):
        keys, values = [], []
        for n in sorted({len(p) for p in pieces}):
            rows = [(p, i) for p, i in zip(pieces, ids, strict=True) if len(p) == n]
            h = self._prefix(np.array([p for p, _ in rows], np.uint32))[:, -1]
            keys.append(mix64(h + U64(n)))
            values.append(np.array([i for _, i in rows], np.int32))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        assert len(np.unique(keys)) == len(keys)
        return keys[order], values[order]

    def _splits(self, pieces, ids):
        """The two parts whose merge makes each piece: merge the units of the piece by rank, down to two parts."""
        left, right = np.full(len(self.rank), -1, np.int64), np.full(len(self.rank), -1, np.int64)
        for p, i in zip(pieces, ids, strict=True):
            if len(p) == 1:
                continue
            parts = [(u,) for u in p]
            while len(parts) > 2:
                best = min(((self.rank[m], k) for k in range(len(parts) - 1) if (m := self.of.get(parts[k] + parts[k + 1])) is not None), default=None)
                if best is None:
                    break
                k = best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and parts[0] in self.of and parts[1] in self.of:
                left[i], right[i] = self.of[parts[0]], self.of[parts[1]]
        return left, right

    def _pairs(self, pieces, ids):
        """Every pair of pieces that joins to a piece."""
        found = {}
        for p, i in zip(pieces, ids, strict=True):
            for k in range(1, len(p)):
                a, b = self.of.get(p[:k]), self.of.get(p[k:])
                if a is not None and b is not None:
                    found[(a << 32) | b] = i
        keys = np.array(sorted(found), np.int64)
        return keys, np.array([found[k] for k in keys.tolist()], np.int64)

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b may stand side by side. Undoes the latest merge of either side, step by step:
        at each step the pair that then touched must not have been merged before the side was."""
        n = len(a)
        fits = np.ones(n, bool)
        x, y, at = a.astype(np.int64), b.astype(np.int64), np.arange(n)
        never = np.iinfo(np.int64).max
        end_x, end_y = np.full(n, never), np.full(n, never)
        known = (x < len(self.rank)) & (y < len(self.rank))
        x, y, at, end_x, end_y = x[known], y[known], at[known], end_x[known], end_y[known]
        while len(at):
            key = (x << 32) | y
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = self.pair_keys[k] == key
            when = np.where(hit, self.rank[self.pair_ids[k]], never)
            bad = hit & (when < end_x) & (when <= end_y)
            fits[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            x, y, at, end_x, end_y, rx, ry = (v[on] for v in (x, y, at, end_x, end_y, rx, ry))
            undo = rx > ry
            end_x, end_y = np.where(undo, rx, end_x), np.where(undo, end_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
            whole = (x >= 0) & (y >= 0)
            x, y, at, end_x, end_y = (v[whole] for v in (x, y, at, end_x, end_y))
        return fits

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As _fit, through a cache of the pairs met before."""
        key = (a.astype(U64) << U64(32)) | b.astype(U64)
        slot = (mix64(key) & U64(self.slots - 1)).astype(np.int64)
        out = self.fits_there[slot]
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            got = self._fit((pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64))
            out[new] = got[back]
            where = (mix64(pairs) & U64(self.slots - 1)).astype(np.int64)
            # several pairs may share a slot; each writes key and value at once, the last one stays
            last = np.full(len(where), True)
            _, first = np.unique(where[::-1], return_index=True)
            last[:] = False
            last[len(where) - 1 - first] = True
            self.seen[where[last]], self.fits_there[where[last]] = pairs[last], got[last]
        return out

    def alone(self, unit: np.ndarray) -> np.ndarray:
        """Ids of single units."""
        known, back = np.unique(unit, return_inverse=True)
        return np.array([self.single.get(int(u), self.size + int(u)) for u in known], np.int64)[back]

    def encode(self, units: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the words, and the ids of all words one after another."""
        counts = np.zeros(len(starts), np.int64)
        ids: list[np.ndarray] = []
        where: list[np.ndarray] = []
        warm = self.longest + 64
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        n_long = int(np.searchsorted(-lengths[order], -(STRETCH + 1) * warm, side="right"))
        lo = n_long
        while lo < len(order):
            hi = lo + max(1, CELLS // int(lengths[order[lo]]))
            some = order[lo:hi]
            last, step = self._words(units, starts[some], lengths[some])
            edges = np.arange(len(some)) * len(last)
            counts[some], flat = _back(last.T.reshape(-1), step.T.reshape(-1), edges, lengths[some])
            ids.append(flat)
            where.append(some)
            lo = hi
        if n_long:
            some = order[:n_long]
            last, step, edges = self._long(units, starts[some], lengths[some], warm)
            counts[some], flat = _back(last, step, edges, lengths[some])
            ids.append(flat)
            where.append(some)
        edges = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(edges[-1], np.int64)
        for some, flat in zip(where, ids, strict=True):
            out[ragged(edges[some], counts[some])] = flat
        return counts, out

    def _words(self, units, starts, lengths):
        """Last tokens and their lengths of all prefixes of words, in order of falling length: arrays by end and word."""
        last = np.full((int(lengths[0]) + 1, len(starts)), -1, np.int32)
        step = np.zeros(last.shape, np.int32)
        self._advance(units, starts, lengths, last, step, 0)
        return last, step

    def _matches(self, units, starts, lengths, known: int):
        """All places where a piece of two units or more stands and ends after `known`: ends, words, sizes and ids, in order of
        end, then size. Substrings of all words are probed a size at a time."""
        n, width = len(starts), int(lengths[0])
        grid = np.zeros((n, width), np.uint32)
        inside = np.arange(width) < lengths[:, None]
        grid[inside] = units[ragged(starts, lengths)]
        single = self.alone(grid.ravel()).reshape(n, width).T
        prefix = np.ascontiguousarray(self._prefix(grid).T)
        going = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")
        power = powers(_STEP, self.longest + 1)
        found = []
        for size in self.by_length[::-1]:
            low = max(known + 1, size)
            if size == 1 or low > width:
                continue
            m = int(going[low - 1])
            key = mix64(prefix[low:, :m] - prefix[low - size : width + 1 - size, :m] * power[size] + U64(size)).reshape(-1)
            maybe = np.flatnonzero(self.sieve[key >> U64(42)])
            if not len(maybe):
                continue
            key = key[maybe]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            maybe, k = maybe[hit], k[hit]
            end, word = maybe // m + low, maybe % m
            true = end <= lengths[word]
            found.append((end[true].astype(np.int32), word[true].astype(np.int32), np.full(int(true.sum()), size, np.int32), self.values[k[true]]))
        if not found:
            found.append(tuple(np.zeros(0, np.int32) for _ in range(4)))
        end, word, size, token = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        return single, end[order], word[order], size[order], token[order]

    def _advance(self, units, starts, lengths, last, step, known: int) -> None:
        """Fills last and step from the end after `known`. At each unit, all words that still go on choose their last token: of
        the pieces that stand there and may follow the token before them, the longest, else the unit alone."""
        single, end, word, size, token = self._matches(units, starts, lengths, known)
        last[known + 1 :], step[known + 1 :] = single[known:], 1
        edge = np.searchsorted(end, np.arange(last.shape[0] + 1)).tolist()
        for i in range(known + 1, last.shape[0]):
            a, b = edge[i], edge[i + 1]
            if a == b:
                continue
            w, s, t = word[a:b], size[a:b], token[a:b]
            before = last[i - s, w]
            fits = before < 0
            ask = np.flatnonzero(~fits)
            if len(ask):
                fits[ask] = self.fit(before[ask].astype(np.int64), t[ask].astype(np.int64))
            w = w[fits]
            # in order of size: of several for a word, the last one stays
            last[i, w], step[i, w] = t[fits], s[fits]

    def _long(self, units, starts, lengths, warm: int):
        """The same for long words, one after another in flat arrays, and where each begins."""
        span, reach = STRETCH * warm, self.longest
        chunks = -(-lengths // span)
        word = np.repeat(np.arange(len(starts)), chunks)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        edges = np.cumsum(lengths + 1) - (lengths + 1)
        last = np.full(int((lengths + 1).sum()), -1, np.int32)
        step = np.zeros(len(last), np.int32)
        own = nth * span  # the end before a chunk's first unit
        top = np.minimum(own + span, lengths[word])
        used = np.full((len(word), reach), -1, np.int32)  # the last tokens that a chunk went on from
        back = np.arange(reach) - reach + 1

        def keep(rows: np.ndarray, base: np.ndarray, got_last, got_step) -> None:
            """Stores the chunks' own parts."""
            n = top[rows] - own[rows]
            to = ragged(edges[word[rows]] + own[rows] + 1, n)
            column = np.repeat(np.arange(len(rows)), n)
            line = ragged(own[rows] + 1 - base, n)
            last[to], step[to] = got_last[line, column], got_step[line, column]

        def batches(rows: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
            """Indexes into rows, long chunks first, as many as advance at once."""
            order = np.argsort(-(top[rows] - base), kind="stable")
            return [order[lo : lo + max(1, CELLS // (span + warm))] for lo in range(0, len(order), max(1, CELLS // (span + warm)))]

        every = np.arange(len(word))
        base = np.maximum(own - warm, 0)
        for some in batches(every, base):
            got_last, got_step = self._words(units, starts[word[some]] + base[some], top[some] - base[some])
            keep(every[some], base[some], got_last, got_step)
            later = np.flatnonzero(nth[some] > 0)
            used[some[later]] = got_last[(own[some] - base[some])[later, None] + back, later[:, None]]

        def before(rows: np.ndarray) -> np.ndarray:
            """The last tokens that the neighbours before have found."""
            return last[(edges[word[rows]] + own[rows])[:, None] + back]

        def again(rows: np.ndarray, context: np.ndarray) -> None:
            """Advances chunks from the last tokens before them."""
            base = own[rows] - reach
            for some in batches(rows, base):
                n = top[rows[some]] - base[some]
                got_last = np.full((int(n[0]) + 1, len(some)), -1, np.int32)
                got_step = np.zeros(got_last.shape, np.int32)
                got_last[1 : reach + 1] = context[some].T
                # nothing before the context is asked for by a piece that ends behind it
                got_last[0] = last[edges[word[rows[some]]] + base[some]]
                self._advance(units, starts[word[rows[some]]] + base[some], n, got_last, got_step, reach)
                keep(rows[some], base[some], got_last, got_step)
            used[rows] = context

        later = every[nth > 0]
        for _ in range(ROUNDS):
            context = before(later)
            bad = (context != used[later]).any(1)
            if not bad.any():
                break
            again(later[bad], context[bad])
        seen: dict[bytes, int] = {}
        for r in later[(before(later) != used[later]).any(1)].tolist() if len(later) else ():
            # a chunk's tokens may have changed since: this one and those after it in the word, until one agrees
            while r < len(word) and nth[r] > 0:
                rows = np.array([r])
                context = before(rows)
                if (context == used[rows]).all():
                    break
                a = starts[word[r]] + own[r] - reach
                key = context.tobytes() + units[a : a + top[r] - own[r] + reach].tobytes()
                twin = seen.get(key)
                if twin is None or twin == r:
                    again(rows, context)
                    if len(seen) < 10_000:
                        seen[key] = r
                else:
                    n = int(top[r] - own[r])
                    x, y = int(edges[word[r]] + own[r]) + 1, int(edges[word[twin]] + own[twin]) + 1
                    last[x : x + n], step[x : x + n] = last[y : y + n], step[y : y + n]
                    used[r] = context[0]
                r += 1
        return last, step, edges


def _back(last: np.ndarray, step: np.ndarray, edges: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Follows the backpointers of all words from their ends, by doubling: token counts, and tokens in order of word and
    place. Words stand in flat arrays from their edges on."""
    here = np.arange(len(last), dtype=np.int64)
    jump = here - step
    on = np.zeros(len(last), bool)
    at = edges + lengths
    on[at] = True
    while True:
        at = jump[at]
        more = ~on[at]
        if not more.any():
            break
        on[at] = True
        found = np.flatnonzero(on)
        jump = jump[jump]
        at = found
    on[edges] = False
    place = np.flatnonzero(on)
    counts = np.searchsorted(place, edges + lengths, side="right") - np.searchsorted(place, edges, side="right")
    return counts, last[place].astype(np.int64)


class Memo:
    """Remembers numbers found for words by their hashes; slots are fixed in number and overwritten."""

    def __init__(self, slots: int = 1 << 20, numbers: int = 1):
        self.mask = U64(slots - 1)
        self.keys = np.zeros(slots, U64)
        self.values = np.full((numbers, slots), -1, np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The numbers, a row each, -1 where unknown."""
        slot = (h & self.mask).astype(np.int64)
        return np.where(self.keys[slot] == h, self.values[:, slot], -1)

    def put(self, h: np.ndarray, *values: np.ndarray) -> None:
        slot = (h & self.mask).astype(np.int64)
        slot, first = np.unique(slot, return_index=True)
        self.keys[slot] = h[first]
        for row, v in zip(self.values, values, strict=True):
            row[slot] = v[first]
