"""Personal data in texts: patterns with checks, and a character-level BiLSTM-CRF that adds what they miss.

The patterns give the base spans, which always stay. The tagger, a bidirectional LSTM over characters with CRF
transitions, is trained in numpy on labelled spans (made by `labelled`, from a fixed seed: the same weights in every
run); it also knows spellings that the patterns don't, such as "name (at) host" or numbers without a plus. Texts are
cut to overlapping windows, each window is decoded by Viterbi, and the spans of all windows are reconciled over the
text: a span that a window's edge cuts gives way to the one that a neighbour sees whole; where none does, its pieces
are joined and decoded again in windows of twice the width around them, until one has both ends. The surer of two
overlapping spans stays, and none may touch a base span. An added span must hold a digit, "@" or a bracketed "at"
and pass its kind's check; so windows with none of these can't add any and are not decoded.

Defined results: null and empty texts have no spans. Texts have any length; repeated rows get equal results.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# A number that follows a digit was tried from its first digit; starting inside it can't match either.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MAY = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]", re.I)
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by start, then by kind."""
    found: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        left = len(text[last:at].rstrip(_LOCAL)) + last
        m = _HOST.match(text, at + 1) if left < at else None
        if m:
            found.append(("email", left, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=_order)


def _order(s: Span) -> tuple:
    return s[1], KINDS.index(s[0]), s[2]


_AT, _DOT = re.compile(r"\s*[(\[]\s*at\s*[)\]]\s*|\s*@\s*", re.I), re.compile(r"\s*[(\[]\s*(?:dot|\.)\s*[)\]]\s*|\.", re.I)


def plausible(kind: str, span: str) -> bool:
    """The check of an added span, by what its kind is made of: parts of an address, numbers of a host, digits that a checksum
    or a numbering plan allows. How these are written is left to the tagger."""
    digits = _NO_DIGIT.sub("", span)
    if not span or span != span.strip() or "\n" in span:
        return False
    if kind == "email":
        sides = _AT.split(span)
        host = _DOT.split(sides[-1])
        return len(sides) == 2 and len(host) > 1 and all(host) and sides[0] != "" and not re.search(r"\s", "".join([sides[0], *host]))
    if kind == "ip":
        parts = _DOT.split(span)
        return all(x.isascii() and x.isdigit() for x in parts) and _octets(parts)
    if kind == "card":
        return span[0].isdigit() and span[-1].isdigit() and 12 <= len(digits) <= 19 and luhn(digits)
    return span[-1].isdigit() and 9 <= len(digits) <= 15 and digits != span and not re.search(r"[A-Za-z]", span)


# --- the tagger

TAGS = 1 + 2 * len(KINDS)  # outside, and begin and inside of each kind
WIDTH, STEP = 96, 56
#: Characters between a span and a window's edge for the span to count as whole.
EDGE = 8
HIDDEN = 14
CHARS = 130
#: Least mean probability of an added span's tags.
SURE = 0.95


def ids_of(text: str) -> np.ndarray:
    """Characters as numbers: ASCII as it is, letters beyond it 128, all else 129."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(points < 128, points, np.where(points < 0x2000, 128, 129))


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters by name: embedding into gates and recurrence of both directions, projection to tags, transitions."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"trans": np.zeros((TAGS, TAGS), np.float32), "out": (r.normal(size=(2 * h, TAGS)) * 0.2).astype(np.float32), "bias": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p["e" + d] = (r.normal(size=(CHARS, 4 * h)) * 0.3).astype(np.float32)
            self.p["r" + d] = (r.normal(size=(h, 4 * h)) * 0.2).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction over windows x (width, n), in reading order, and what the way back needs."""
        e, r, c = self.p["e" + d], self.p["r" + d], self.p["c" + d]
        width, n = x.shape
        h, s = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        states, kept = np.zeros((width, n, HIDDEN), np.float32), []
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            z = e[x[t]] + h @ r + c
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            s_new = f * s + i * g
            th = np.tanh(s_new)
            if keep:
                kept.append((t, h, s, i, f, o, g, th))
            h, s = o * th, s_new
            states[t] = h
        return states, kept

    def emissions(self, x: np.ndarray, keep: bool = False):
        (hf, kf), (hb, kb) = self._run(x, "f", keep), self._run(x, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        out = both @ self.p["out"] + self.p["bias"]
        return (out, both, kf, kb) if keep else out

    def marginals(self, em: np.ndarray):
        """Log partition and log probabilities of tags."""
        width, n, _ = em.shape
        trans = self.p["trans"]
        a, b = np.zeros_like(em), np.zeros_like(em)
        a[0] = em[0]
        for t in range(1, width):
            a[t] = em[t] + _logsum(a[t - 1][:, :, None] + trans[None], 1)
        for t in range(width - 2, -1, -1):
            b[t] = _logsum(trans[None] + (em[t + 1] + b[t + 1])[:, None, :], 2)
        z = _logsum(a[-1], 1)
        return z, a, b

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        width, n, _ = em.shape
        score, back = em[0], np.zeros((width, n, TAGS), np.int8)
        for t in range(1, width):
            all_ = score[:, :, None] + self.p["trans"][None]
            back[t] = all_.argmax(1)
            score = em[t] + all_.max(1)
        tags = np.zeros((width, n), np.int64)
        tags[-1] = score.argmax(1)
        for t in range(width - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean loss of windows and its gradients."""
        em, both, kf, kb = self.emissions(x, keep=True)
        width, n, _ = em.shape
        z, a, b = self.marginals(em)
        rows = np.arange(n)
        gold = sum(em[t][rows, y[t]] for t in range(width)) + sum(self.p["trans"][y[t - 1], y[t]] for t in range(1, width))
        d_em = np.exp(a + b - z[None, :, None])
        for t in range(width):
            d_em[t][rows, y[t]] -= 1
        d_trans = np.zeros((TAGS, TAGS))
        for t in range(1, width):
            pair = a[t - 1][:, :, None] + self.p["trans"][None] + (em[t] + b[t])[:, None, :] - z[:, None, None]
            d_trans += np.exp(pair).sum(0)
            np.subtract.at(d_trans, (y[t - 1], y[t]), 1)
        d_em /= n
        g = {"trans": d_trans / n, "out": np.einsum("tnh,tnk->hk", both, d_em), "bias": d_em.sum((0, 1))}
        d_both = d_em @ self.p["out"].T
        for d, kept, part in (("f", kf, d_both[:, :, :HIDDEN]), ("b", kb, d_both[:, :, HIDDEN:])):
            e, r = np.zeros_like(self.p["e" + d]), np.zeros_like(self.p["r" + d])
            c = np.zeros_like(self.p["c" + d])
            dh, ds = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h, s, i, f, o, gg, th in reversed(kept):
                dh = dh + part[t]
                ds = ds + dh * o * (1 - th * th)
                dz = np.concatenate([ds * gg * i * (1 - i), ds * s * f * (1 - f), dh * th * o * (1 - o), ds * i * (1 - gg * gg)], axis=1)
                np.add.at(e, x[t], dz)
                r += h.T @ dz
                c += dz.sum(0)
                dh, ds = dz @ self.p["r" + d].T, ds * f
            g |= {"e" + d: e, "r" + d: r, "c" + d: c}
        return float((z - gold).mean()), g


def train(windows: int = 1600, epochs: int = 9, batch: int = 80, rate: float = 0.02, seed: int = 1) -> Tagger:
    """Adam over labelled windows. All numbers are fixed, so all runs give the same tagger."""
    x, y = labelled(windows, seed)
    model = Tagger(seed)
    m = {k: np.zeros_like(v, dtype=np.float64) for k, v in model.p.items()}
    v = {k: np.zeros_like(w, dtype=np.float64) for k, w in model.p.items()}
    r, step = np.random.default_rng(seed + 1), 0
    steps = epochs * (windows // batch)
    for _ in range(epochs):
        order = r.permutation(windows)
        for lo in range(0, windows - batch + 1, batch):
            some = order[lo : lo + batch]
            _, g = model.gradients(x[some].T, y[some].T)
            size = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            step += 1
            for k, w in g.items():
                w = w * min(1.0, 5.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * w
                v[k] = 0.99 * v[k] + 0.01 * w * w
                now = rate * (1 - 0.9 * step / steps)
                model.p[k] = (model.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


@lru_cache(1)
def tagger() -> Tagger:
    return train()


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of characters and their tags: words with labelled spans of all kinds in many spellings, and with numbers,
    dates, versions, codes and handles that are none."""
    r = np.random.default_rng(seed)

    def pick(*xs):
        return xs[int(r.integers(len(xs)))]

    def digits(k: int) -> str:
        return "".join(map(str, r.integers(0, 10, k)))

    def word() -> str:
        w = "".join(pick("th", "er", "an", "ing", "on", "le", "de", "qu", "sch", "é", "ß", "ñ", "a", "re", "in", "ou", "ti") for _ in range(int(r.integers(1, 5))))
        return w.capitalize() if r.random() < 0.1 else w

    def ascii_word() -> str:
        return "".join(pick("th", "er", "an", "ing", "on", "le", "de", "mail", "web", "a", "re", "in", "ou", "ti") for _ in range(int(r.integers(1, 4))))

    def email() -> str:
        local = pick(ascii_word() + pick(".", "_", "") + digits(2), ascii_word() + "." + ascii_word(), ascii_word())
        host = [ascii_word() + pick("", digits(1)), pick("example", ascii_word()), pick("com", "org", "net", "de")][int(r.integers(2)) :]
        return local + pick("@", "@", "@", " (at) ", " [at] ", "[at]", "(at)", " @ ") + pick(".", ".", ".", " [dot] ", "(dot)").join(host)

    def ip() -> str:
        return pick(".", ".", ".", "[.]", "(.)").join(str(int(k)) for k in r.integers(0, 256, 4))

    def card() -> str:
        base = pick("4", "5", "3") + digits(14)
        base += next(str(k) for k in range(10) if luhn(base + str(k)))
        return pick("", " ", "-", "", ".", "/").join(base[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{digits(1)} ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"+{pick('49', '33', '34')} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{pick('49', '33')} {a} {b} {c}", f"{a}/{b} {c}")

    def other() -> str:
        return pick(digits(int(r.integers(1, 7))), f"{digits(2)}.{digits(2)}.20{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", "@" + ascii_word(), f"{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)}", '"' + "".join(pick(*"0123456789abcdef") for _ in range(32)) + '"', f"{digits(2)}-{digits(2)}", f"{digits(1)}.", f"({digits(1)})", f"{digits(9)}")

    make = dict(zip(KINDS, (email, ip, card, phone), strict=True))
    xs, ys = np.zeros((n, WIDTH), np.int64), np.zeros((n, WIDTH), np.int64)
    for k in range(n):
        text, tags, near = "", [], False
        while len(text) < 3 * WIDTH:
            # spans often stand next to each other, or to a number that is none
            roll = r.random() * (0.35 if near else 1.0)
            if roll < 0.14:
                kind = pick(*KINDS)
                new = make[kind]()
                mark = [1 + 2 * KINDS.index(kind)] + [2 + 2 * KINDS.index(kind)] * (len(new) - 1)
            else:
                new = other() if roll < 0.2 else word()
                mark = [0] * len(new)
            near = not near and roll < 0.14
            tail = pick(" ", " ", " ", " ", " ", ", ", ".\n", ". ", "!! ", " | ", "### ")
            text, tags = text + new + tail, tags + mark + [0] * len(tail)
        a = int(r.integers(0, WIDTH))
        xs[k], ys[k] = ids_of(text[a : a + WIDTH]), tags[a : a + WIDTH]
    return xs, ys


def windows_of(text: str) -> list[int]:
    """Starts of the windows that may hold a span."""
    starts, last = [], -1
    for m in _MAY.finditer(text):
        first = max(0, -(-(m.end() - WIDTH) // STEP))
        for k in range(max(first, last + 1), m.start() // STEP + 1):
            starts.append(k * STEP)
            last = k
    return starts


def joined_pieces(pieces: list[Span]) -> list[Span]:
    """Pieces of one kind that touch or overlap, as one."""
    out: list[Span] = []
    for kind, s, e in sorted(pieces, key=lambda p: (KINDS.index(p[0]), p[1])):
        if out and out[-1][0] == kind and s <= out[-1][2]:
            out[-1] = (kind, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((kind, s, e))
    return out


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]], most: int = 512) -> list[list[Span]]:
    """Spans that the tagger adds to each text's base spans."""
    found: list[list[tuple[float, Span]]] = [[] for _ in texts]
    places, width = [(i, a) for i, t in enumerate(texts) for a in windows_of(t)], WIDTH
    waiting: list[list[Span]] = [[] for _ in texts]
    while places or any(waiting):
        _decode(model, texts, places, width, max(1, most * WIDTH // width), found, waiting)
        width *= 2
        places = []
        for i, pieces in enumerate(waiting):
            if not pieces:
                continue
            whole = base[i] + [s for _, s in found[i]]
            waiting[i] = []
            for kind, s, e in joined_pieces(pieces):
                # any span around it would touch a base span, or is seen whole
                if any(s2 < e and s < e2 for _, s2, e2 in base[i]) or any(k2 == kind and s2 <= s and e <= e2 for k2, s2, e2 in whole):
                    continue
                if 2 * (e - s) > width and width < 2 * len(texts[i]):
                    waiting[i].append((kind, s, e))
                else:
                    places.append((i, max(0, (s + e) // 2 - width // 2)))
        places = list(dict.fromkeys(places))
    return _chosen(texts, base, found)


def _decode(model: Tagger, texts: list[str], places: list[tuple[int, int]], width: int, most: int, found: list, cut: list) -> None:
    """Decodes windows (text, start): spans seen whole are added to `found`, pieces that an edge cuts to `cut`."""
    for lo in range(0, len(places), most):
        some = places[lo : lo + most]
        x = np.full((len(some), width), 10, np.int64)
        for k, (i, a) in enumerate(some):
            part = ids_of(texts[i][a : a + width])
            x[k, : len(part)] = part
        em = model.emissions(x.T)
        tags = model.viterbi(em).T
        z, f, b = model.marginals(em if width == WIDTH else em.astype(np.float64))  # sums over long windows are large
        sure = np.exp(np.take_along_axis(f + b, tags.T[:, :, None], 2)[:, :, 0] - z[None]).T
        for k in np.flatnonzero((tags > 0).any(1)):
            i, a = some[k]
            n = len(texts[i])
            for kind, s, e in tag_spans(tags[k], a > 0):
                # this near an edge a span may look whole and go on behind it; a part of a word gets a window around it, too
                seen = (s > EDGE or a == 0) and (e < width - EDGE or a + width >= n)
                if not seen or width == WIDTH and _part(texts[i], a + s, a + e):
                    cut[i].append((kind, a + s, min(a + e, n)))
                elif a + e <= n:
                    found[i].append((float(sure[k, s:e].mean()), (kind, a + s, a + e)))


def _part(text: str, s: int, e: int) -> bool:
    """A part of a longer number or name is none of its own."""
    return s > 0 and text[s - 1].isalnum() or e < len(text) and text[e].isalnum()


def _chosen(texts: list[str], base: list[list[Span]], found: list[list[tuple[float, Span]]]) -> list[list[Span]]:
    """Of overlapping spans the surer one, if it is plausible and touches no base span."""
    out = []
    for text, own, new in zip(texts, base, found, strict=True):
        taken, chosen = [(s, e) for _, s, e in own], []
        for p, (kind, s, e) in sorted(set(new), key=lambda x: (-x[0], _order(x[1]))):
            if p >= SURE and plausible(kind, text[s:e]) and not any(s < e2 and s2 < e for s2, e2 in taken):
                if not _part(text, s, e):
                    chosen.append((kind, s, e))
                    taken.append((s, e))
        out.append(chosen)
    return out


def tag_spans(tags: np.ndarray, midway: bool = False) -> list[Span]:
    """Spans of tags; midway, a span may begin before the first tag."""
    out: list[Span] = []
    start = kind = None
    if midway and tags[0] and tags[0] % 2 == 0:
        start, kind = 0, (tags[0] - 1) // 2
    for k, t in enumerate([*tags.tolist(), 0]):
        if start is not None and (t == 0 or t % 2 == 1 or (t - 1) // 2 != kind):
            out.append((KINDS[kind], start, k))
            start = None
        if t and t % 2 == 1:
            start, kind = k, (t - 1) // 2
    return out


def find(model: Tagger, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    full = [t or "" for t in texts]
    some = [i for i, t in enumerate(full) if _MAY.search(t)]
    base: list[list[Span]] = [[] for _ in full]
    for i in some:
        base[i] = base_spans(full[i])
    every = list(base)
    for i, new in zip(some, added_spans(model, [full[i] for i in some], [base[i] for i in some]), strict=True):
        every[i] = sorted(base[i] + new, key=_order)
    return list(zip(base, every, strict=True))



def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256 and spans of every row. One pass, no shuffle."""
    model = tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in groups(batch.column(1), 4_000_000):
                part = batch.slice(a, b - a)
                found = find(model, part.column(1).to_pylist())
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([written(every) for _, every in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, spans], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    out = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping ones, the union by the first's."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of documents, personal data in text replaced, n_chars brought up to date where it is."""
    model = tagger()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for a, b in groups(batch.column(k), 4_000_000):
                part = batch.slice(a, b - a)
                texts = part.column(k).to_pylist()
                new = [None if t is None else masked(t, every) for t, (_, every) in zip(texts, find(model, texts), strict=True)]
                cols = [part.column(i) for i in range(part.num_columns)]
                cols[k] = pa.array(new, part.schema.field(k).type)
                if "n_chars" in names:
                    c = names.index("n_chars")
                    cols[c] = pa.array([None if t is None else len(t) for t in new], part.schema.field(c).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
