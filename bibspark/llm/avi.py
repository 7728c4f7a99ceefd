"""AVI files with motion-JPEG frames: a lossless writer for bytes, a reader by RIFF index, and shots as timed clips.

A payload byte is one 8x8 block of even grey: its DC coefficient, quantised by 8, is the byte less 128, so decoding
gives the byte back as each of the block's samples. The DC table gives every size class a code that is as much
shorter as the class has more bits, and the only AC symbol (end of block) has 4 bits: a block always takes 16 bits
and no 0xFF can arise. Such scans are decoded by one table lookup for all blocks; any other baseline grey scan is
decoded bit by bit with an inverse cosine transform.

Defined results: null and empty texts give a payload of 64 zero bytes, one frame. The payload's length stands in a
chunk of its own; the rest of the last frame is zero. One file holds less than 4 GB, the limit of RIFF.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups

UNIT = 64
WIDE, HIGH = 64, 16  # blocks of a frame
FPS = 25
BINS = 16
#: A shot begins where the difference of histograms is above DEVIATIONS standard deviations over the mean of the shot so far, and above LEAST.
DEVIATIONS, LEAST = 3.0, 0.15


@lru_cache(1)
def _codes() -> tuple[np.ndarray, np.ndarray, bytes]:
    """Block words by DC difference + 255, differences by word, and the tables as a DHT segment."""
    words, back = np.zeros(511, np.uint16), np.full(1 << 16, 9999, np.int16)
    code, length, of = 0, 4, {}
    for size in range(8, -1, -1):  # canonical codes, shortest first
        of[size] = code
        code, length = (code + 1) << 1, length + 1
    for d in range(-255, 256):
        size = abs(d).bit_length()
        word = (of[size] << size | (d if d > 0 else d - 1 + (1 << size) if d else 0)) << 4
        words[d + 255] = word
        back[word] = d
    counts = bytes(1 if 4 <= n <= 12 else 0 for n in range(1, 17))
    dc = bytes([0x00]) + counts + bytes(range(8, -1, -1))
    ac = bytes([0x10]) + bytes(1 if n == 4 else 0 for n in range(1, 17)) + bytes([0])
    return words, back, _segment(0xC4, dc + ac)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(64)
def _jpeg_head(wide: int, high: int) -> bytes:
    table = _segment(0xDB, bytes([0]) + bytes([8] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + bytes([1, 0x11, 0]))
    scan = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + table + frame + _codes()[2] + scan


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def padded(text: bytes) -> bytes:
    """A text as payload: zeros up to a positive multiple of UNIT."""
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def write_avi(payload: bytes) -> bytes:
    rows = -(-len(payload) // WIDE)
    high = min(HIGH, rows)
    n = -(-rows // high)
    blocks = np.zeros((n, high * WIDE), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    steps = np.empty(blocks.shape, np.int16)
    steps[:, 0] = blocks[:, 0].astype(np.int16) - 128
    np.subtract(blocks[:, 1:], blocks[:, :-1], out=steps[:, 1:], dtype=np.int16)
    scans = _codes()[0][steps + 255].astype(">u2")
    head = _jpeg_head(WIDE, high)
    size = len(head) + 2 * blocks.shape[1] + 2
    frame_head, end = b"00dc" + struct.pack("<I", size) + head, b"\xff\xd9"
    movi = b"movi" + b"".join(part for s in scans for part in (frame_head, s.tobytes(), end))
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.arange(n) * (size + 8)
    index[:, 3] = size
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, size, 8 * WIDE, 8 * high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, n, size, -1, 0, 0, 0, 8 * WIDE, 8 * high)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * WIDE, 8 * high, 1, 8, b"MJPG", 64 * WIDE * high, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl + _chunk(b"plen", struct.pack("<Q", len(payload))))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes()))


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError(f"chunk {name!r} goes beyond its parent")
        yield name, at + 8, size
        at += 8 + size + (size & 1)


class Avi:
    """A parsed file: frames by its index, frames a second, and the payload length if it is one of ours."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("no AVI file")
        self.data, self.fps, self.length, movi, self.frames = view, float(FPS), None, None, []
        entries = b""
        for name, at, size in _chunks(view, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
            kind = bytes(view[at : at + 4]) if name == b"LIST" else b""
            if kind == b"hdrl":
                for inner, a, n in _chunks(view, at + 4, at + size):
                    if inner == b"avih" and (us := struct.unpack_from("<I", data, a)[0]):
                        self.fps = 1e6 / us
                    elif inner == b"plen":
                        self.length = struct.unpack_from("<Q", data, a)[0]
                    del n
            elif kind == b"movi":
                movi = at
            elif name == b"idx1":
                entries = view[at : at + size]
        if movi is None:
            raise ValueError("no frames")
        table = np.frombuffer(entries, "<u4").reshape(-1, 4)
        video = table[(table[:, 0] >> 16) == int.from_bytes(b"dc", "little")].astype(np.int64)
        # offsets count from the list's name or from the file's start
        base = movi if len(video) and data[movi + int(video[0, 2]) : movi + int(video[0, 2]) + 4] == b"00dc" else 0
        self.frames = [(base + o + 8, n) for o, n in video[:, 2:].tolist()]
        if any(a + n > len(data) for a, n in self.frames):
            raise ValueError("the index points beyond the file")

    def samples(self) -> np.ndarray:
        """The grey of the blocks of all frames, where all blocks are even."""
        return np.concatenate([decode_jpeg(self.data[a : a + n])[::8, ::8].reshape(-1) if s is None else s for s, (a, n) in zip(self._fast(), self.frames, strict=True)])

    def _fast(self) -> list[np.ndarray | None]:
        """Frames of our own form, decoded at once: equal heads are parsed once."""
        out: list[np.ndarray | None] = []
        size = len(_jpeg_head(WIDE, HIGH))
        known: dict[bytes, bool] = {}
        for a, n in self.frames:
            frame = self.data[a : a + n]
            high, odd = divmod(n - size - 2, 2 * WIDE)
            head = bytes(frame[:size])
            if odd or not 1 <= high <= HIGH or not known.setdefault(head, head == _jpeg_head(WIDE, high)):
                out.append(None)
                continue
            steps = _codes()[1][np.frombuffer(frame, ">u2", WIDE * high, size)]
            if (steps == 9999).any():
                raise ValueError("a code that the tables don't have")
            out.append((np.cumsum(steps, dtype=np.int32) + 128).astype(np.uint8))
        return out

    def payload(self) -> bytes:
        if self.length is None:
            raise ValueError("no payload length")
        return self.samples()[: self.length].tobytes()


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@lru_cache(1)
def _cosines() -> np.ndarray:
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)


def decode_jpeg(data: bytes | memoryview) -> np.ndarray:
    """The samples of a baseline JPEG of one component (grey)."""
    data = bytes(data)
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    quant, trees, at = {}, {}, 2
    high = wide = table = 0
    restart = 0
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    quant[body[0] & 15], body = np.frombuffer(body, ">u2", 64, 1).astype(float), body[129:]
                else:
                    quant[body[0] & 15], body = np.frombuffer(body, np.uint8, 64, 1).astype(float), body[65:]
        elif marker == 0xC4:
            while body:
                counts, total = body[1:17], sum(body[1:17])
                tree, code, k = {}, 0, 17
                for length in range(1, 17):
                    for _ in range(counts[length - 1]):
                        tree[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                trees[body[0]], body = tree, body[17 + total :]
        elif marker == 0xC0:
            _, high, wide, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("more than one component")
            table = body[8]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            dc, ac = trees[body[2] >> 4], trees[0x10 | body[2] & 15]
            break
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("no baseline JPEG")
    end = data.rfind(b"\xff\xd9")
    pieces, scan = [], data[at:end]
    if restart:
        import re

        pieces = re.split(rb"\xff[\xd0-\xd7]", scan)
    else:
        pieces = [scan]
    rows, cols = -(-high // 8), -(-wide // 8)
    coefficients = np.zeros((rows * cols, 64))
    block = 0
    for piece in pieces:
        raw = piece.replace(b"\xff\x00", b"\xff")
        bits, n, p, before = int.from_bytes(raw, "big"), 8 * len(raw), 0, 0

        def take(k: int) -> int:
            nonlocal p
            if p + k > n:
                raise ValueError("the scan ends early")
            p += k
            return (bits >> (n - p)) & ((1 << k) - 1)  # noqa: B023

        def symbol(tree) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)  # noqa: B023
                if (length, code) in tree:
                    return tree[length, code]
            raise ValueError("no such code")

        def value(k: int) -> int:
            v = take(k)  # noqa: B023
            return v if not k or v >> (k - 1) else v - (1 << k) + 1

        for _ in range(restart or rows * cols):
            if block == rows * cols:
                break
            before += value(symbol(dc))
            coefficients[block, 0] = before
            k = 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    coefficients[block, k] = value(s & 15)
                k += 1
            block += 1
    grid = np.zeros((rows * cols, 64))
    grid[:, _ZIGZAG] = coefficients * quant[table]
    c = _cosines()
    pixels = np.einsum("xu,nuv,yv->nxy", c, grid.reshape(-1, 8, 8), c) + 128
    image = np.clip(np.rint(pixels), 0, 255).astype(np.uint8).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3)
    return image.reshape(8 * rows, 8 * cols)[:high, :wide]


def differences(frames: np.ndarray) -> np.ndarray:
    """Halved sums of differences between the histograms of neighbouring frames, as shares; 0 for the first."""
    n, size = frames.shape
    if n < 2:
        return np.zeros(n)
    cells = (frames >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    hist = np.bincount(cells.reshape(-1), minlength=n * BINS).reshape(n, BINS)
    return np.concatenate([[0], np.abs(np.diff(hist, axis=0)).sum(1) / (2 * size)])


def shots(diff: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot. The threshold adapts to the differences within the shot so far."""
    out, start = [], 0
    if (diff <= LEAST).all():
        return [(0, len(diff) - 1)]
    n = total = square = 0.0
    for i in range(1, len(diff)):
        d = float(diff[i])
        mean = total / n if n else 0.0
        spread = max(square / n - mean * mean, 0.0) ** 0.5 if n else 0.0
        if d > LEAST and d > mean + DEVIATIONS * spread:
            out.append((start, i - 1))
            start, n, total, square = i, 0.0, 0.0, 0.0
        else:
            n, total, square = n + 1, total + d, square + d * d
    return [*out, (start, len(diff) - 1)]


def clips(avi: Avi, samples: np.ndarray) -> list[dict]:
    """Timed clip rows of a file."""
    frames = samples.reshape(len(avi.frames), -1)
    diff = differences(frames)
    return [
        {"clip": k, "first_frame": a, "last_frame": b, "start_s": round(a / avi.fps, 6), "end_s": round((b + 1) / avi.fps, 6), "cut": round(float(diff[a]), 6), "mean_grey": round(float(frames[a : b + 1].mean()), 4)}
        for k, (a, b) in enumerate(shots(diff))
    ]


CLIP = "clip int, first_frame int, last_frame int, start_s double, end_s double, cut double, mean_grey double"


def to_avi(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary): each whole text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in groups(batch.column(1), 2_000_000):
                part = batch.slice(a, b - a)
                media = [write_avi(padded((t or "").encode())) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """The clips of each media file, one row a clip. Null and broken media give one row with the error and no clip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    avi = Avi(raw or b"")
                    rows = [{"doc_id": doc, **c, "error": None} for c in clips(avi, avi.samples())]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows = [{"doc_id": doc, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"doc_id long, {CLIP}, error string"))
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id long, {CLIP}, error string")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Writes each text to a file, reads the file back, and returns digests and the clips as a string. Files live in
    the task only, one at a time. feature: frames@rate|first-last:cut of each clip,..."""

    def row(doc, text: str | None):
        raw = (text or "").encode()
        media = write_avi(padded(raw))
        avi = Avi(media)
        samples = avi.samples()
        payload = samples[: avi.length].tobytes()
        feature = f"{len(avi.frames)}@{avi.fps:g}|" + ",".join(f"{c['first_frame']}-{c['last_frame']}:{c['cut']:.4f}" for c in clips(avi, samples))
        return doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [row(part.column(0)[i].as_py(), part.column(1)[i].as_py()) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in map(list, zip(*rows, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)
