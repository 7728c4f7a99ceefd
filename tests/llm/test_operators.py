"""The corpus operators against brute force, libraries and round trips, on small and odd tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspark.llm import avi, htmltext, jaccard, mixing, pii, quality, queries, resampling, sentencepiece, tokencount, warc

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, sf=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- nulls, empty and long texts, ties, repeated rows, empty tables, clashing names

WHOLE = {
    "count_tokens": lambda d: tokencount.count_tokens(d, queries.tokenizer("byte_bpe_50k.json")),
    "round_trip": lambda d: sentencepiece.round_trip(d, queries.tokenizer("piece_bpe_32k.model")),
    "encode": lambda d: sentencepiece.encode(d, queries.tokenizer("piece_bpe_32k.model")),
    "judge": lambda d: quality.judge(d, min_docs=2, percent=0),
    "copies": mixing.copies,
    "detect": pii.detect,
    "digests": avi.digests,
    "weigh": lambda d: resampling.weigh(d, np.zeros(resampling.BUCKETS)),
}


@pytest.mark.parametrize("name", WHOLE)
def test_odd_tables(odd, clashing, empty, name):
    f = WHOLE[name]
    got = f(odd)
    assert got.count() == odd.count()
    assert rows(f(clashing)) == rows(got)
    assert f(empty).count() == 0


def test_odd_jaccard(odd, clashing, empty):
    got = rows(jaccard.jaccard_groups(odd))
    assert len(got) == odd.count()
    assert rows(jaccard.jaccard_groups(clashing)) == got and jaccard.jaccard_groups(empty).count() == 0
    of = {d: (n, c) for d, n, c in got}
    assert of[None] == of[4]
    assert of[1] == (0, 1) and of[2] == (0, 2) and of[3] == (0, 3) and of[5][1] == of[6][1] == 4 and of[9][1] == 8 and of[7] == (1, 7)


@pytest.mark.parametrize("stage", [quality.keep, jaccard.one_of_each, pii.redact, mixing.mix])
def test_odd_stages(odd, clashing, empty, stage):
    got = stage(odd)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    wide = stage(clashing)
    assert wide.columns == clashing.columns
    assert rows(wide.select(odd.columns)) == rows(got)
    assert stage(empty).count() == 0


# --- quality rules


def brute_gone(docs, min_docs=5, percent=1, keep_first=False):
    """Whether a line of a document goes, by id, source and line."""
    lines, hosts = defaultdict(lambda: defaultdict(set)), defaultdict(set)

    def key(s, line):
        return s, re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()

    for d, t, s in docs:
        hosts[s].add(t)
        for line in (t or "").split("\n"):
            if WORDS.search(line):
                lines[key(s, line)][t].add(d)

    def gone(d, s, line):
        k = lines[key(s, line)] if WORDS.search(line) else ()
        if not len(k) > min_docs or not 100 * len(k) > percent * len(hosts[s]):
            return False
        return not (keep_first and d == min((i for ds in k.values() for i in ds if i is not None), default=None))

    return gone


def brute_quality(docs, min_left=30, **limits):
    out, gone = {}, brute_gone(docs, **limits)
    for d, t, s in docs:
        w = WORDS.findall(t or "")
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = set()
        for i in range(len(w) - 7):
            if win[tuple(w[i : i + 8])] > 1:
                hit |= set(range(i, i + 8))
        ls = [x for x in (t or "").split("\n") if WORDS.search(x)]
        n = sum(len(WORDS.findall(x)) for x in ls if gone(d, s, x))
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        left = len(w) - n
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(hit), failed, n, not failed and left >= 20 and 100 * left >= min_left * len(w))
    return out


def test_quality(spark):
    r = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "h").alias("source"))
    extra = [(10_000 + i, "Shared line of text that is long enough to count for something here today\n" * 3 + " ".join(r.choice("abcdefgh") for _ in range(r.randint(5, 60))), "h") for i in range(20)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    every = [tuple(x) for x in docs.collect()]
    for first in (False, True):
        want = brute_quality(every, min_docs=2, percent=5, keep_first=first)
        got = {x[0]: tuple(x)[1:] for x in quality.judge(docs, min_docs=2, percent=5, keep_first=first).collect()}
        assert got == want and sum(v[6] > 0 for v in want.values()) > 10


@pytest.mark.parametrize("first", [False, True])
def test_frequent_lines_leave_the_texts(spark, first):
    """At the limits of the query, on a large host and a small one: verdicts, and texts without the lines."""
    r = random.Random(6)
    shared = [f"All rights of {k} reserved by the host of these many pages" for k in range(3)]
    often = (400, 6, 12)  # documents of 800 that have each line: the second is below the limit
    own = ["\n".join(" ".join(r.choice("abcdefghijklm") + str(r.randrange(99)) for _ in range(14)) for _ in range(4)) for _ in range(800)]
    held = [set(r.sample(range(1, 800), n)) for n in often]
    docs = []
    for i, t in enumerate(own):
        ls = t.split("\n")
        for k, h in enumerate(held):
            if i in h:
                ls.insert(k + 1, shared[k].upper() + " " if i % 3 == 0 else shared[k])
        docs.append((i, "\n".join(ls) + "\n" * (i % 2), "h" if i else None))
    # a host of 12: a line of 6 documents goes, one of 5 stays
    docs += [(1000 + i, "\n".join([shared[0]] * (i < 6) + [shared[1]] * (i < 5) + [own[i]]), "small") for i in range(12)] + [docs[7]]
    df = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, source string, n_chars int").repartition(3)
    want = brute_quality(docs, keep_first=first)
    assert {x[0]: tuple(x)[1:] for x in quality.judge(df, keep_first=first).collect()} == want and sum(v[6] > 0 for v in want.values()) > 400
    gone = {("h", shared[0].lower()): min(held[0]), ("h", shared[2].lower()): min(held[2]), ("small", shared[0].lower()): 1000}
    left = []
    for d, t, s in docs:
        if want[d][-1]:
            t = "\n".join(x for x in t.split("\n") if (key := (s, x.strip(" ").lower())) not in gone or first and gone[key] == d)
            left.append((d, t, s, len(t)))
    got = quality.keep(df, keep_first=first)
    assert got.dtypes == df.dtypes and rows(got) == sorted(left, key=repr)
    for host in ("h", "small"):
        assert sum(shared[0].lower() in t.lower() for _, t, s, _ in left if s == host) == first
    assert sum(shared[1].lower() in t.lower() for _, t, s, _ in left if s == "small") == 5
    assert not re.search("Python|Arrow|Pandas|Cartesian", got._jdf.queryExecution().toString())


def test_lines_are_removed_at_sf001(spark):
    """The line rule decides on the given tables."""
    got = queries.op10_quality_rules(spark, SF.replace("0.001", "0.01")).collect()
    assert sum(x["n_removed"] > 0 for x in got) > 50 and any(x["kept"] == x["base_failed"] for x in got)


def test_quality_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (queries.op10_quality_rules(spark, SF), quality.facts(docs)):
        assert not re.search("Python|Arrow|Pandas|Cartesian", df._jdf.queryExecution().toString())


# --- tokenizers


def strings(n, seed):
    r = random.Random(seed)
    parts = ["'s", "'ll", "'re", "'l", "'", "r", "v", "e", "l", " ", "  ", "\n", "\t", "\x85", "!", "12", "٣", "é", "日本", "a", "the", "<|endoftext|>", "<|endo", "😀", "​", "²", "▁", "　", "\x00"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    some = strings(3000, 1) + list(texts(spark).values()) + ["ab " * 400_000 + "z" * 500]
    want = [len(e.ids) for e in tok.encode_batch(some, add_special_tokens=False)]
    assert tokencount.counter(path).count(some).tolist() == want
    got = {r["doc_id"]: r for r in queries.op5_token_counts(spark, SF).collect()}
    for d, t in texts(spark).items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[d]["n_tokens"], got[d]["n_bytes"], got[d]["over_limit"]) == (n, len(t.encode()), n > 512)


def test_transducer_chunks():
    """State maps composed over chunks give the borders that a plain walk gives."""
    r = np.random.default_rng(0)
    classes = r.integers(0, 12, 5000).astype(np.uint8)
    classes[-1] = tokencount.END
    state, marks = tokencount.START, set()
    for i, c in enumerate(classes.tolist()):
        state, emits = tokencount._move(state, c)
        marks |= {i} if emits & 1 else set()
        marks |= {i - 1} if emits & 2 else set()
    assert tokencount.borders(classes).tolist() == sorted(marks)


def test_sentencepiece(spark):
    import sentencepiece as lib

    path = queries.tokenizer("piece_bpe_32k.model")
    model, c = lib.SentencePieceProcessor(model_file=path), sentencepiece.codec(path)
    some = strings(2000, 2) + list(texts(spark).values()) + ["é" * 3000 + " ab" * 200_000]
    ids, edges = c.encode(some)
    back = c.decode(ids, edges)
    want = model.encode(some)
    for k, w in enumerate(want):
        assert ids[edges[k] : edges[k + 1]].tolist() == w
    assert [b.decode("utf-8", "replace") for b in back] == model.decode(want)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    enc = sentencepiece.encode(docs, path)
    assert {r["doc_id"]: r["text"] for r in sentencepiece.decode(enc, path).collect()} == texts(spark)
    got = {r["doc_id"]: r for r in queries.op2_sentencepiece(spark, SF).collect()}
    for d, t in texts(spark).items():
        w = np.array(model.encode(t), "<i4")
        assert (got[d]["n_pieces"], got[d]["ids_sha256"], got[d]["exact"]) == (len(w), hashlib.sha256(w.tobytes()).hexdigest(), True)


# --- Jaccard join


def brute_groups(docs, n, percent):
    sets = {}
    for d, t in docs.items():
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids, parent = sorted(sets), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, n=60, length=(3, 200)):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    out = []
    while len(out) < n:
        w = [r.choice(vocab) for _ in range(r.randint(*length))]
        if r.random() < 0.4:
            w += passage.split()
        for _ in range(r.choice((1, 1, 2, 5))):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(v) // 60))):
                v[r.randrange(len(v))] = r.choice(vocab)
            out.append(" ".join(v))
    return dict(enumerate(out))


@pytest.mark.parametrize(("words", "percent", "seed", "part"), [(3, 90, 1, 500), (5, 80, 2, 500), (1, 60, 3, 500), (2, 95, 4, 500), (3, 80, 5, 3), (1, 30, 6, 5)])
def test_jaccard(spark, words, percent, seed, part):
    docs = near_copies(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_groups(df, words, percent, part_rows=part).collect()}
    want = brute_groups(docs, words, percent)
    assert got == want and len({c for _, c in want.values()}) < len(docs)
    kept = {r["doc_id"] for r in jaccard.one_of_each(df, words, percent).collect()}
    assert kept == {c for _, c in want.values()}


def test_jaccard_query(spark):
    got = {r[0]: (r[1], r[2]) for r in queries.op8_jaccard_join(spark, SF).collect()}
    assert got == brute_groups(texts(spark), 3, 90)


def test_jaccard_frequent_grams_lose_nothing(spark):
    """Whatever n-grams are left out of the slices, linked sets share a key."""
    r = np.random.default_rng(5)
    for percent in (60, 80, 90):
        for _ in range(150):
            n = int(r.integers(1, 300))
            base = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            frequent = np.sort(r.choice(base, int(r.integers(0, len(base) + 1)), replace=False))
            cut = jaccard.Slices(percent, frequent)
            other = np.unique(np.concatenate([r.choice(base, max(1, int(len(base) * (1 - r.random() * 0.2))), replace=False), r.integers(0, 2**63, int(r.integers(0, 1 + len(base) // 12))).astype(np.uint64)]))
            if jaccard.linked(base, other, percent):
                assert np.intersect1d(cut.hashes(base), cut.hashes(other)).size


def test_blocks_of_many_groups():
    r = np.random.default_rng(2)
    centres = [np.unique(r.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([c[r.random(len(c)) > 0.04], r.integers(0, 2**63, 2).astype(np.uint64)])) for c in centres for _ in range(25)]
    link = np.array([[i != j and jaccard.linked(x, y, 80) for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    label = np.arange(len(sets))
    while (new := np.minimum(label, np.where(link, label, len(sets)).min(1))).tolist() != label.tolist():
        label = new
    for room, dense in ((500, 200), (500, 0), (10**7, 10**9)):  # pairs counted, in one go or in many, and dense products
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(jaccard, "DENSE", dense)
            patch.setattr(jaccard, "TILE", 64)
            assert (jaccard.links(sets, 80, room) == link).all()
            assert (jaccard.block_components(sets, 80, room=room) == label).all()
    known = [i % 2 if i < 50 else i for i in range(len(sets))]
    both = jaccard.block_components(sets, 80, joined_before=known)
    assert len(set(both[:50].tolist())) <= 2 and len(set(both.tolist())) <= len(set(label.tolist()))


def test_jaccard_without_ids(spark):
    """Rows without an id link, join others, and have no component if they reach no id."""
    base = [f"w{i}" for i in range(100)]

    def text(k):  # neighbours link, and others don't
        return " ".join(base[: 100 - 3 * k])

    docs = [(3, text(0)), (None, text(1)), (9, text(2)), (None, "a b c d"), (None, "a b c d"), (None, None), (5, None), (-4, "x y z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard.jaccard_groups(df).collect()), key=repr)
    assert got == sorted([(3, 98, 3), (None, 95, 3), (9, 92, 3), (None, 2, None), (None, 2, None), (None, 0, None), (5, 0, 5), (-4, 1, -4)], key=repr)
    kept = sorted(map(tuple, jaccard.one_of_each(df).collect()), key=repr)
    assert kept == sorted([(3, text(0)), (None, "a b c d"), (None, None), (5, None), (-4, "x y z")], key=repr)


def test_repeated_rows_are_rows(spark):
    docs = [(1, "a b c d e")] * 40 + [(2, "a b c d e")] * 3 + [(2, "other words here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = Counter(map(tuple, jaccard.jaccard_groups(df).collect()))
    assert got == {(1, 3, 1): 40, (2, 3, 1): 3, (2, 1, 2): 1} or got == {(1, 3, 1): 40, (2, 3, 1): 3, (2, 1, 1): 1}


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}


# --- mixing


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.copies(docs)
    assert rows(got) == rows(mixing.copies(docs.repartition(7)))
    by = got.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("size"), F.sum("taken").alias("taken"), F.sum("size").alias("sum"), F.max("copies").alias("most")).collect()
    order = sorted(r["source"] for r in by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = sum(r["size"] for r in by)
    want, left, rest = {}, set(order), float(total)
    size = {r["source"]: r["size"] for r in by}
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
            rest -= want[s]
            left.remove(s)
    for r in by:
        assert r["size"] == r["sum"] and r["most"] <= 3
        assert r["target"] == pytest.approx(want[r["source"]])
        assert abs(r["taken"] - r["target"]) <= 0.05 * r["target"]
    assert mixing.mix(docs).count() == got.agg(F.sum("copies")).first()[0]


def test_targets_full(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    t = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(2015) and t["b"] == pytest.approx(2 * t["c"]) and t[None] == 15


# --- WARC


def test_warc(spark):
    r = random.Random(0)
    long = "x" * 600 + "é" * 300
    rows_ = [(i, f"http://h/{i}", long if i in (2, 5, 9) else "short" if i in (3, 4) else "".join(chr(r.randrange(32, 900)) for _ in range(1500))) for i in range(12)] + [(50, None, None), (51, "http://h/ä b\n", "")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string").repartition(3)
    got = {x["page_id"]: x for x in warc.round_trip(pages).collect()}
    assert len(got) == len(rows_)
    for p, _, h in rows_:
        raw = (h or "").encode()
        to = 9 if p in (2, 5) else None
        assert (got[p]["payload_bytes"], got[p]["payload_digest"], got[p]["record_type"], got[p]["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to)
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = spark.conf.get("spark.checkpoint.dir") + "/warc"
    warc.write(pages, folder)
    assert {x["page_id"]: bytes(x["payload"]).decode() for x in warc.read(spark, folder).filter("record_type = 'response'").collect()} == {p: h or "" for p, _, h in rows_ if p not in (2, 5)}


def test_warc_rows_of_the_query(spark):
    pages = {x["page_id"]: x["html"] for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    largest = {}
    for p, h in pages.items():
        if len(h.encode()) >= 1000:
            largest[h] = max(p, largest.get(h, p))
    for x in queries.op3_warc_salvage(spark, "/root/testdata/sf0.01").collect():
        to = largest.get(pages[x["page_id"]])
        assert x["refers_to"] == (to if to != x["page_id"] else None)


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_salvage(packed, seed):
    r = random.Random(seed)
    recs = [warc.record(i, f"http://x/{i}", bytes(r.randrange(256) for _ in range(500))) for i in range(12)]
    parts = [warc.member(x) if packed else x for x in recs]
    ends = np.cumsum([len(x) for x in parts])
    data = bytearray(b"".join(parts))
    hit = r.randrange(1, 10)
    data[ends[hit] - 30] ^= 0xFF  # in the payload or its checksum
    out = list(warc.salvage(bytes(data)))
    found = [x["head"]["warc-record-id"] for k, x in out if k == "record"]
    assert found == [f"<{warc.URI}{i}>" for i in range(12) if i != hit]
    gaps = [x for k, x in out if k == "gap"]
    assert [x[:2] for x in gaps] == [(ends[hit - 1], ends[hit])] and gaps[0][2]
    cut = bytes(b"".join(parts)[: ends[5] + 40])
    out = list(warc.salvage(cut))
    assert sum(k == "record" for k, _ in out) == 6 and out[-1][0] == "gap" and out[-1][1][:2] == (ends[5], len(cut))


def ids_and_gaps(data):
    out = list(warc.salvage(data))
    return [int(x["head"]["warc-record-id"].strip("<>").removeprefix(warc.URI)) for k, x in out if k == "record"], [x for k, x in out if k == "gap"]


def test_salvage_inside_members():
    """Records before and after a bad one of the same member, and those of members with a broken end."""
    r = random.Random(9)
    recs = [warc.record(i, f"http://x/{i}", bytes(r.randrange(97, 120) for _ in range(900))) for i in range(6)]
    bad = bytearray(recs[1])
    bad[-40] ^= 1
    edges = np.cumsum([0, *map(len, recs)]).tolist()
    after = warc.member(warc.record(9, None, b"after"))
    # a sound member with a bad second record
    one = warc.member(b"".join([recs[0], bytes(bad), *recs[2:]]))
    ids, gaps = ids_and_gaps(one + after)
    assert ids == [0, 2, 3, 4, 5, 9] and [g[3:] for g in gaps] == [(edges[1], edges[2])] and gaps[0][:3] == (0, len(one), "block digest")
    # junk between records, and a length that leads beyond the next record
    wrong = re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", rb"Content-Length: 99\1\r\n\r\nHTTP", recs[3])
    assert ids_and_gaps(warc.member(b"".join([recs[0], b"junk", recs[1], wrong, recs[4]])))[0] == [0, 1, 4]
    # a trailer that is cut, or wrong
    whole = warc.member(b"".join(recs))
    for broken in (whole[:-5], whole[:-8] + b"\0" * 8, whole[:-1]):
        ids, gaps = ids_and_gaps(broken + after)
        assert ids == [0, 1, 2, 3, 4, 5, 9] and len(gaps) == 1 and gaps[0][3] == edges[-1]
        assert ids_and_gaps(broken)[0] == [0, 1, 2, 3, 4, 5]
    # a stream that is cut, at the file's end and before another member, or has a wrong byte
    for k in (len(whole) // 2, len(whole) - 40):
        for tail in (b"", after):
            ids, gaps = ids_and_gaps(whole[:k] + tail)
            assert ids[: len(ids) - bool(tail)] == list(range(len(ids) - bool(tail))) and len(ids) > 1 and (not tail or ids[-1] == 9)
            assert gaps[0][0] == 0 and gaps[-1][1] == k
    damaged = bytearray(whole)
    damaged[len(whole) // 2] ^= 0xFF
    ids, gaps = ids_and_gaps(bytes(damaged) + after)
    assert ids[0] == 0 and ids[-1] == 9 and gaps
    # without a digest nothing of a damaged member is proved
    bare = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:7>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert ids_and_gaps(warc.member(bare))[0] == [7] and ids_and_gaps(warc.member(bare)[:-3] + after)[0] == [9]
    # a header with a name, and an extra field
    plain = warc.member(recs[0])
    assert ids_and_gaps(plain[:3] + b"\x0c" + plain[4:10] + b"\x02\0ab" + b"name\0" + plain[10:])[0] == [0]


def test_salvage_is_linear():
    import time

    r = random.Random(10)
    parts = [bytearray(warc.member(warc.record(i, None, bytes(r.randrange(256) for _ in range(300))))) for i in range(20_000)]
    for x in parts:
        x[-2] ^= 0xFF  # every trailer
    began = time.perf_counter()
    out = list(warc.salvage(b"".join(map(bytes, parts))))
    assert sum(k == "record" for k, _ in out) == 20_000 and time.perf_counter() - began < 30
    for x in parts:
        x[30] ^= 0xFF  # every stream
    began = time.perf_counter()
    assert sum(k == "gap" for k, _ in warc.salvage(b"".join(map(bytes, parts)))) >= 1 and time.perf_counter() - began < 30


def test_odd_archives(spark):
    """Repeated rows, null ids, ties on the largest id, very long pages, clashing names; archives bounded by bytes."""
    long = "z" * 3000
    rows_ = [(1, "u", long), (1, "u", long), (None, "v", long), (7, "w", long), (7, "w", long), (None, None, None), (8, "x", "é" * 400_000), (None, "y", "q" * 2000)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = sorted(((x["page_id"], x["record_type"], x["refers_to"], x["payload_bytes"]) for x in warc.round_trip(pages).collect()), key=repr)
    want = [(1, "revisit", 7, 3000)] * 2 + [(None, "revisit", 7, 3000)] + [(7, "response", None, 3000)] * 2 + [(None, "response", None, 0), (8, "response", None, 800_000), (None, "response", None, 2000)]
    assert got == sorted(want, key=repr)
    wide = pages.select("*", *(F.lit("own").alias(c) for c in ("_digest", "_first", "members", "refers_to")))
    assert sorted(((x["page_id"], x["record_type"], x["refers_to"], x["payload_bytes"]) for x in warc.round_trip(wide).collect()), key=repr) == got
    r = random.Random(11)
    noise = [(i, None, "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(3000))) for i in range(60)]
    folder = spark.conf.get("spark.checkpoint.dir") + "/bounded"
    warc.write(spark.createDataFrame(noise, pages.schema).coalesce(1), folder, unit=10_000, units=4)
    files = spark.read.format("binaryFile").load(folder).select("length").collect()
    assert len(files) > 5 and max(x[0] for x in files) < 5 * 10_000 + 10_000
    assert warc.read(spark, folder).filter("error IS NULL").count() == 60


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><div class="ad">Buy <b>now</b></div><p>First&nbsp;para <b>bold<br>next</b>
 text</p><script>var t="</p>";</script><p>Second <!-- gone --> one<p>Be.</p><aside>Side</aside></article><section id="comments"><p>A comment</p></section>
<form><p>Sign up</p></form><footer>&copy; x</footer></body></html>"""


def test_html():
    assert htmltext.extract(PAGE) == "Head & line\nFirst para bold next text\nSecond one\nBe."
    assert htmltext.extract(None) == "" and htmltext.extract("") == "" and htmltext.extract("<p>") == ""
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert "First para bold next text" in htmltext.extract(bare) and "comment" not in htmltext.extract(bare)
    assert htmltext.extract("<article><p>cut &amp; o") == "cut & o"
    assert htmltext.extract("<nav>" * 5000 + "x") == ""
    assert len(htmltext.extract("<p>" + "word " * 200_000)) == 999_999


def test_line_blocks():
    assert htmltext.regions([3, 4, 0, 80, 90, 5, 0, 6, 0]) == [(3, 6)]
    assert htmltext.regions([3, 0, 5]) == [(2, 3)] and htmltext.regions([0, 0]) == []


def test_surge_and_dive_without_marks():
    """Article text on pages without article or main: menus next to it go, short stretches next to it or within stay."""
    r = random.Random(8)

    def para(n):
        return "".join(r.choice("abcdefg ") for _ in range(n)).replace("  ", " x").strip() + "."

    ad, menu = '<div class="ad">Buy now, this is a long advert of more than forty characters</div>', "<ul>" + "".join(f'<li><a href="/{k}">Item number {k} of the menu</a></li>' for k in range(6)) + "</ul>"
    first, last = [para(1200) for _ in range(3)], para(200)
    short = [para(12), para(60), "- one", "- two", "- three"]
    body = "".join(f"<p>{x}</p>" for x in first)
    want = "\n".join(" ".join(x.split()) for x in first)
    for tag in ("div", "article", "main"):
        page = f"<body><{tag}>{{}}</{tag}></body>"
        assert htmltext.extract(page.format(menu + "<h1>A head</h1>" + body + menu)) == "A head\n" + want, tag
        assert htmltext.extract(page.format(body + ad + f"<p>{last}</p>")) == want + "\n" + " ".join(last.split()), tag
        between = "".join(f"<p>{x}</p>" for x in short)
        got = htmltext.extract(page.format(body + ad + between + ad + body + "<p>End.</p>"))
        assert got == want + "\n" + "\n".join(" ".join(x.split()) for x in short) + "\n" + want + "\nEnd.", tag
    links = '<ul><li><a href="/1">One</a><li><a href="/2">Two</a><li><a href="/3">Three</a></ul>'
    assert htmltext.extract(f"<article>{links}</article>") == "One\nTwo\nThree"
    assert htmltext.extract("<body><p><a href='/x'>open" + f"{body}</body>") == "open\n" + want
    # a list of plain lines is no menu
    assert htmltext.extract(f"<body>{body}<ul><li>Salt<li>Oil<li>Milk<li>Eggs</ul></body>") == want + "\nSalt\nOil\nMilk\nEggs"


BODY = "<h1>Title here</h1>" + "".join(f"<p>Paragraph {i} of the body, with enough words to count as text in any window of lines.</p>" for i in range(5))
WRAPPERS = ['div class="content with-sidebar"', 'div id="page" class="has-header"', 'div class="widget-content"', 'section role="search-results"', 'form id="aspnetForm"', 'div class="header"', 'div class="page sidebar"']


@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "{}"])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_keep_the_article(wrapper, inner):
    want = "Title here\n" + "\n".join(re.findall("<p>(.*?)</p>", BODY))
    page = f"<body><nav><a href=/>Home</a></nav><{wrapper}>{inner.format(BODY)}</{wrapper.split()[0]}><footer>Foot of the page</footer></body>"
    assert htmltext.extract(page) == want


def test_marks_are_hints():
    """Marks of parts of the text, teasers, leads, comments, and names of several words."""
    want = htmltext.extract(f"<body><article>{BODY}</article></body>")
    named = '<p class="share-price">Three dollars</p><p class="notice">A notice</p><div class="alert">An alert</div>'
    assert htmltext.extract(f"<article>{BODY}{named}</article>") == want + "\nThree dollars\nA notice\nAn alert"
    assert htmltext.extract(f"<body><article>Short teaser</article><div>{BODY}</div></body>").endswith(want)
    assert htmltext.extract(f'<body><div><p>A short lead.</p><nav><a href="/">Home</a></nav>{BODY}</div></body>') == "A short lead.\n" + want
    long = "<article>A comment of many words, longer than all that it is about. " * 30 + "</article>"
    assert htmltext.extract(f'<body><article>{BODY}</article><section id="comments">{long}</section></body>') == want
    assert htmltext.extract(f'<body><div>{BODY}</div><div class="comment-list"><article class="comment">First!</article></div></body>') == want
    assert htmltext.extract(f"<body><div>{BODY}</div><aside><article>Teaser one</article></aside></body>") == want
    around = '<div class="ad-slot">Buy now and more</div><div id="cookie-notice">We use cookies</div>{}<div class="newsletter-signup"><form>Give your mail</form></div>'
    assert htmltext.extract(around.format(f"<article>{BODY}</article>")) == htmltext.extract(around.format(BODY)) == want
    assert htmltext.extract('<body><div class="ad">An advert of more text than the page has</div><p>Short.</p></body>') == "Short."
    assert htmltext.extract('<article><p>A <span class="ad">word</span> and <button>press</button>more <i hidden>no</i>end</p></article>') == "A word and more end"


def test_line_blocks_decide():
    """On pages without article or main, lines of bare containers at both ends go by their windows."""
    want = htmltext.extract(f"<article>{BODY}</article>")
    menu, foot = "".join(f"<div>{x}</div>" for x in ("Home", "About", "Contact")), "<div>Terms</div><div>2024</div>"
    assert htmltext.extract(f"<body>{menu}{BODY}{foot}</body>") == want
    assert htmltext.regions([4, 5, 7, 80, 90, 5], solid=[False] * 6) == [(3, 5)]


def test_odd_pages(spark):
    rows_ = [(1, "u", BODY), (1, "u", BODY), (None, None, BODY), (2, None, None), (3, "v", ""), (4, "w", "<p>" + "long " * 100_000), (5, "x", "<<<>>&&#;</p></"), (6, "y", "plain text")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in htmltext.main_text(pages).collect()), key=repr)
    assert got == sorted(((p, u, htmltext.extract(h), len(htmltext.extract(h))) for p, u, h in rows_), key=repr)
    wide = pages.select("*", *(F.lit("own").alias(c) for c in ("text", "n_chars", "level", "plain")))
    assert sorted((tuple(r) for r in htmltext.main_text(wide).collect()), key=repr) == got
    assert htmltext.main_text(pages.limit(0)).collect() == []


def test_html_query(spark):
    import html

    got = {r["page_id"]: r for r in queries.op6_html_text(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div)\b[^>]*>", body)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        assert got[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


# --- AVI


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 1025, 70_000])
def test_avi_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    payload = avi.padded(raw)
    assert len(payload) % 64 == 0 and payload.startswith(raw) and len(payload) >= 64
    data = avi.write_avi(payload)
    a = avi.Avi(data)
    assert a.payload() == payload and a.fps == 25
    start, size = a.frames[-1]
    image = avi.decode_jpeg(data[start : start + size])
    fast = a._fast()[-1].reshape(image.shape[0] // 8, -1)
    assert (image == np.kron(fast, np.ones((8, 8), np.uint8))).all()


def test_avi_broken():
    data = avi.write_avi(avi.padded(b"abc" * 100))
    for bad in (b"", data[:100], b"RIFX" + data[4:]):
        with pytest.raises((ValueError, IndexError, zlib.error)):
            avi.Avi(bad).payload()


def test_shots():
    a, b = np.zeros((5, 1024), np.uint8), np.full((4, 1024), 200, np.uint8)
    diff = avi.differences(np.concatenate([a, b]))
    assert avi.shots(diff) == [(0, 4), (5, 8)]


def test_avi_queries(spark, odd):
    for d in queries.op7_avi_mjpeg(spark, SF).collect():
        payload = avi.padded(texts(spark)[d["doc_id"]].encode())
        assert (d["payload_bytes"], d["payload_sha256"], d["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    clips = avi.clip_rows(avi.to_avi(odd)).filter("error is null")
    assert clips.filter("clip = 0").count() == odd.count() and clips.filter("end_s <= start_s").count() == 0


# --- personal data


def brute_base(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans(spark):
    r = random.Random(7)
    parts = ["a", "b.c", "@", "@@", ".", "x.org", "_d", " ", "1", "10.", "255", "256.1.2.3", "4111111111111111", "4111-1111 1111 1111", "+", "+1 (555) 123-4567", "-", "(", ")", "é"]
    some = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(6000)] + list(texts(spark, "/root/testdata/sf0.01").values())
    for t in some:
        assert pii.base_spans(t) == brute_base(t), t
    assert sum(len(brute_base(t)) for t in some) > 1000
    long = "1" * 200_000 + "a" * 200_000 + "@" + "+" * 1000
    assert pii.base_spans(long) == []


def test_tagger():
    model = pii.tagger()
    x, y = pii.labelled(300, 99)
    em = model.emissions(x.T)
    tags = model.viterbi(em).T
    hit = made = real = 0
    for a, b in zip(tags, y, strict=True):
        p, q = set(pii.tag_spans(a)), set(pii.tag_spans(b))
        hit, made, real = hit + len(p & q), made + len(p), real + len(q)
    assert hit / made > 0.85 and hit / real > 0.8  # windows cut some spans
    text = "Write to john.doe (at) mail.example.com or call (564) 555-4526, host 10[.]0[.]0[.]12 and card 4539.1488.0343.6467. Also a@b.c, 1.2.3.4"
    base, every = pii.find(model, [text])[0]
    assert set(base) <= set(every) and {text[s:e] for _, s, e in every} >= {"john.doe (at) mail.example.com", "(564) 555-4526", "a@b.c", "1.2.3.4"}


def test_gradients():
    m = pii.Tagger(3)
    x, y = (v[:, :10].T for v in pii.labelled(3, 5))
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    _, g = m.gradients(x, y)
    for k, v in g.items():
        at = np.unravel_index(np.abs(v).argmax(), v.shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-4
        up = m.gradients(x, y)[0]
        m.p[k][at] = old - 1e-4
        down = m.gradients(x, y)[0]
        m.p[k][at] = old
        assert (up - down) / 2e-4 == pytest.approx(v[at], rel=1e-3)


def test_windows_are_reconciled():
    """A span anywhere in a long text is found as in a short one, whatever windows cut it."""
    model = pii.tagger()
    for shift in range(0, 120, 7):
        text = "the and of " * 30 + "x" * shift + " call (564) 555-4526 now " + "in the of " * 20
        _, every = pii.find(model, [text])[0]
        assert [text[s:e] for _, s, e in every] == ["(564) 555-4526"]


LONG_SPANS = (
    "thering.lastname (at) mailweb.example [dot] com",
    "mail.web (at) thering.mail.onmail.example [dot] com",
    "thering.mailweb.dean.anon (at) thering.mailweb.example [dot] com",
    "thering.mailweb.deanon.ledermail.webmailing (at) mail.thering.onmail.webleder.inde.example [dot] com",
    "thering.mailweb.dean.anon.leder.mail.webmail (at) thering.mailweb.onleder.inwebmail.thering.mail.example.mailthering [dot] com",
)


@pytest.mark.parametrize("span", LONG_SPANS, ids=len)
def test_long_spans_are_reconciled(span):
    """A span longer than the windows' overlap, or than a window, is found at every offset from their edges."""
    model = pii.tagger()
    for shift in range(pii.STEP):
        text = "the and of " * 30 + "x" * shift + " call " + span + " now " + "in the of " * 20
        _, every = pii.find(model, [text])[0]
        assert [text[s:e] for _, s, e in every] == [span], shift
        assert pii.masked(text, every).count("<EMAIL>") == 1


def test_pieces():
    assert pii.joined_pieces([("phone", 5, 9), ("email", 8, 20), ("email", 0, 8), ("email", 22, 30)]) == [("email", 0, 20), ("email", 22, 30), ("phone", 5, 9)]
    assert pii.tag_spans(np.array([2, 2, 0, 1, 2])) == [("email", 3, 5)] and pii.tag_spans(np.array([2, 2, 0, 1, 2]), True) == [("email", 0, 2), ("email", 3, 5)]


def test_pii_query_and_redaction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in queries.op9_pii_tagger(spark, "/root/testdata/sf0.01").collect():
        base = brute_base(texts(spark, "/root/testdata/sf0.01")[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    left = pii.redact(docs)
    assert left.filter("text rlike '@[a-z0-9]+\\\\.example'").count() == 0 and left.filter("n_chars <> length(text)").count() == 0
    assert left.filter("text like '%<EMAIL>%'").count() > 0


# --- resampling


def brute_grams(t):
    w = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+", (t or "").encode().lower() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t or "").encode())
    return [("1", x) for x in w] + [("2", a, b) for a, b in zip(w, w[1:])]


def test_grams(spark):
    some = ["", "a b", "A!! b", None, "é à", *list(texts(spark).values())[:20]]
    got, at = resampling.buckets(some)
    seen = {}
    for k, t in enumerate(some):
        want = brute_grams(t)
        own = got[at[k] : at[k + 1]].tolist()
        assert len(own) == len(want)
        for g, b in zip(want, own, strict=True):
            assert seen.setdefault(g, b) == b


def test_resampling(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(r.choice(("good", "fine", "text") if i % 2 else ("junk!!", "$$$", "spam")) for _ in range(30)), None) for i in range(200)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = resampling.resample(docs, labels)
    kept = {x["doc_id"] for x in got.filter("kept").collect()}
    assert len(kept) == 100 and sum(d % 2 for d in kept) >= 99
    assert rows(got) == rows(resampling.resample(docs.repartition(5), labels))
    none = resampling.resample(docs, labels.limit(0))
    assert none.filter("kept").count() == 200


def test_resampling_against_brute_force(spark):
    """Weights from counted n-grams, ranks and what is kept; the noise is the document's own and moves what is kept."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    raw, target, grams = Counter(), Counter(), {}
    for d, t in docs:
        grams[d] = resampling.buckets([t])[0].tolist()  # held against plain hashing in test_grams
        raw.update(grams[d])
        if good.get(d) == 1:
            target.update(grams[d])

    def log_p(counts, b):
        return math.log((counts[b] + 1) / (sum(counts.values()) + resampling.BUCKETS))

    of = {b: log_p(target, b) - log_p(raw, b) for b in raw}
    got = queries.op1_importance_resampling(spark, SF).collect()
    assert len(got) == len(docs)
    noise = []
    for x in got:
        g = grams[x["doc_id"]]
        assert x["n_grams"] == len(g) and x["log_weight"] == pytest.approx(resampling.LENGTH * sum(of[b] for b in g) / max(len(g), 1), abs=1e-4)
        noise.append(x["gumbel"] - x["log_weight"])
    assert abs(np.mean(noise) - 0.5772) < 0.3 and abs(np.std(noise) - 1.2825) < 0.3
    k = math.ceil(sum(good.values()) / len(good) * len(docs) - 1e-9)
    kept = {x["doc_id"] for x in got if x["kept"]}
    assert kept == {x["doc_id"] for x in sorted(got, key=lambda x: (-x["gumbel"], x["doc_id"]))[:k]}
    half = len(docs) // 2  # the cut stands where few weights lie; in the middle noise decides for many
    assert len({x["doc_id"] for x in sorted(got, key=lambda x: -x["gumbel"])[:half]} ^ {x["doc_id"] for x in sorted(got, key=lambda x: -x["log_weight"])[:half]}) > 4


def test_odd_resampling(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = resampling.resample(odd, labels)
    assert got.count() == odd.count() and rows(resampling.resample(clashing, labels)) == rows(got)
    assert got.filter("kept").count() == math.ceil(0.75 * odd.count())
    assert resampling.resample(empty, labels).count() == 0 and resampling.resample(odd, labels.limit(0)).filter("kept").count() == odd.count()


def test_long_words():
    """Words without a border, of any length, equal the libraries: chunks that agree with their neighbours, and some that don't."""
    import sentencepiece as library
    import tokenizers

    path, model = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
    counter, reference = tokencount.Counter(path), tokenizers.Tokenizer.from_file(path)
    codec, pieces = sentencepiece.Codec(model), library.SentencePieceProcessor(model_file=model)
    r = random.Random(12)
    texts_ = ["x" * 20_000, "ab" * 9000, "aaab" * 4000, "-" * 5000 + "=" * 3333 + "the" * 4000, " " * 5000 + "a" + "\n" * 3000]
    texts_ += ["".join(r.choice(kind) for _ in range(15_000)) for kind in ("abcdefghijklmnopqrstuvwxyz", "ABCabc019+/", ["the", "ing", "qu", "中", "é"], [chr(c) for c in range(0x4E00, 0x9000)])]
    texts_ += ["".join(r.choice("theing") for _ in range(n)) for n in (95, 96, 97, 319, 320, 321, 400, 767, 768, 769, 960, 961, 1536)]
    assert counter.count(texts_).tolist() == [len(x.ids) for x in reference.encode_batch(texts_, add_special_tokens=False)]
    ids, edges = codec.encode(texts_)
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == pieces.encode(texts_)
    assert codec.decode(ids, edges) == [t.encode() for t in texts_]


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(queries.tokenizer("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError, match="no compiled rules"):
            tokencount._known(spec | change)
    tokencount._known(spec)


def test_sums_before(spark):
    from bibspark.llm.ranking import sums_before

    r = random.Random(13)
    values = [(i, r.randrange(5), r.randrange(10**6)) for i in range(500)]
    df = spark.createDataFrame(values, "i int, k int, v long").repartition(7)
    got = {x["i"]: (int(x["s"]), int(x["all_s"])) for x in sums_before(df, [F.asc("k"), F.asc("i")], {"s": "v"}).collect()}
    total, want = 0, {}
    for i, _, v in sorted(values, key=lambda x: (x[1], x[0])):
        want[i], total = total, total + v
    assert got == {i: (s, total) for i, s in want.items()}


def test_scratch_is_removed(spark):
    """What an operator wrote on its way is gone when its result is written."""
    from bibspark.llm import shared

    def step(df):
        return shared.materialize(shared.materialize(df.withColumn("x", F.lit(1))).withColumn("y", F.lit(2))).drop("x")

    docs = spark.range(10)
    with pytest.MonkeyPatch.context() as patch:
        paths = []
        real = shared.shared_path
        patch.setattr(shared, "shared_path", lambda s: paths.append(real(s)) or paths[-1])
        out = shared.chain(docs, [step, lambda d: d.withColumn("z", F.lit(3))])
    assert out.columns == ["id", "y", "z"] and out.count() == 10
    there = [os.path.exists(p.removeprefix("file://")) for p in paths]
    assert there.count(True) == 1 and there[-1]


def test_shuffles_are_removed(spark):
    """What was shuffled for a table is gone when it is written, whether or not the driver collects its garbage."""
    import time

    from bibspark.llm import jaccard, shared

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)

    def shuffled():
        return {b.toString() for b in [f.get(i) for f in [spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllBlocks())] for i in range(f.size())] if b.isShuffle()}

    def added(run):
        held = shuffled()
        run()
        for _ in range(50):  # they go in the background
            if not shuffled() - held:
                break
            time.sleep(0.1)
        return shuffled() - held

    df = spark.range(1000).selectExpr("id", "CAST(id AS string) AS text").repartition(3, "id")
    assert not added(lambda: shared.materialize(df.groupBy("text").count()))
    assert not added(lambda: jaccard.frequent_grams(df, 3, 10))
    assert not added(lambda: jaccard.jaccard_groups(df.withColumnRenamed("id", "doc_id")))
    assert spark.conf.get(name) == before


def test_chains_of_chance_are_cut(spark):
    """A block of sets that share slices by chance falls apart by other hashes; groups stay, and links are those of brute force."""
    from bibspark.llm import jaccard

    r = random.Random(11)
    few = [f"w{i}" for i in range(14)]
    texts = {i: " ".join(r.choice(few) for _ in range(r.randint(20, 40))) for i in range(300)}
    for i in range(0, 60, 3):  # near copies, in groups of three
        texts[i + 1], texts[i + 2] = texts[i] + " end", "start " + texts[i]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute_groups(texts, 3, 80)
    largest = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "_parts", lambda b, *a, f=jaccard._parts: largest.append(b.groupBy("block").count().agg(F.max("count")).first()[0]) or f(b, *a))
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_groups(docs, 3, 80, part_rows=10).collect()}
    assert {d: c for d, (_, c) in got.items()} == {d: c for d, (_, c) in want.items()}
    assert largest[0] > 10 and largest[-1] < largest[0] / 2


def test_shared_tables(spark):
    import os

    from bibspark.llm import shared

    df = shared.materialize(spark.range(10).toDF("x"))
    assert df.count() == 10 and os.path.isdir(shared.shared_root(spark).removeprefix("file://"))
    shared.cleanup(spark)
    assert not os.path.exists(shared.shared_root(spark).removeprefix("file://"))
    assert shared.fresh(spark.createDataFrame([(1, 2)], "_Row int, x int"), "_row") == "_row_"


def test_ranks(spark):
    from bibspark.llm.ranking import rank_within

    r = random.Random(1)
    data = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 20), i) for i in range(500)]
    got = {x["i"]: x["rank"] for x in rank_within(spark.createDataFrame(data, "g string, v int, i int"), "g", [F.desc("v"), F.asc("i")]).collect()}
    for g in ("a", "b", None):
        for n, (_, v, i) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            assert got[i] == n
