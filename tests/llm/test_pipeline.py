"""run() against a brute-force version of all stages."""

import math

import duckdb
from test_operators import SF, brute_gone, brute_groups, brute_quality

import corpus_pipeline
from bibspark.llm import pii, queries


def test_pipeline(spark):
    import sentencepiece

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    gone = brute_gone(rows, keep_first=True)
    kept = {d for d, v in brute_quality(rows, keep_first=True).items() if v[-1]}
    rows = [(d, "\n".join(x for x in t.split("\n") if not gone(d, s, x)), s) for d, t, s in rows if d in kept]
    groups = brute_groups({d: t for d, t, _ in rows}, 5, 80)
    rows = [x for x in rows if x[0] in {c for _, c in groups.values()}]
    model = pii.tagger()
    clean = [(d, pii.masked(t, every), s) for (d, t, s), (_, every) in zip(rows, pii.find(model, [t for _, t, _ in rows]), strict=True)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", clean)
    from bibspark.llm.mixing import ORACLE

    cur = con.execute(ORACLE)
    names = [c[0] for c in cur.description]
    copies = {r[names.index("doc_id")]: r[names.index("copies")] for r in cur.fetchall()}
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = sorted((d, sp.encode(t)) for d, t, _ in clean for _ in range(copies[d]))
    got = sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(want) > 100 and not math.isnan(len(got))


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
