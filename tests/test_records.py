"""Metadata, citations, links, search, fusion and resolution on the fixture records."""

import random

import pytest
from pyspark.sql import functions as F

from bibspark.functions import links
from bibspark.operators import cite, evaluation, ranking, resolve, stats
from bibspark.operators.metadata import extract, item_rows, item_summary, items
from bibspark.plans import api, boolean
from bibspark.plans import search as s
from bibspark.schema import RECORD, Settings, read_env_file
from bibspark.sources import sinks

BOOK = {
    "record_id": "alma990000004242", "title": ["Tidal Gardens: A Field Companion"], "creator": ["Harlow, Ines T.$$QHarlow, Ines T."], "creationdate": ["2012"], "publisher": ["Fen Press"],
    "type": ["book"], "source": ["Alma"], "description": [""], "subject": ["Tidal gardens", "Salt plants", "Coastal botany"], "isbn": ["9781234567897"], "doi": [], "issn": [],
    "linktorsrc": ["$$Uhttps://x.org/a.pdf$$EPDF"], "availability": ["available"], "holding": [("L", "S", "QH95.7")],
}
ARTICLE = {
    "record_id": "alma990000007171", "title": ["Slow Rivers and Their Bridges"], "creator": ["Okafor, Lena M.$$QOkafor, Lena M.", "Brandt, Timo K.$$QBrandt, Timo K."], "creationdate": ["2023"], "publisher": [""],
    "type": ["article"], "source": ["Annals of River Works"], "subject": ["Slow rivers"], "isbn": [], "issn": ["2049-3630"], "doi": ["10.5555/arw.9.777"], "volume": ["76"], "issue": ["3"], "spage": ["1"], "epage": ["45"], "pages": ["1-45"],
    "linktohtml": ["https://x.org/h"], "linktopdf": ["https://x.org/p.pdf"], "openaccess": ["free"], "availability": ["available_online"],
}
LONE = {"record_id": "x1", "title": ["Edited"], "creator": [], "contributor": ["Editor, Joe"]}
BARE = {"record_id": "x2", "title": ["Only a title"]}


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in RECORD.fields) for r in rows], RECORD)


@pytest.fixture(scope="module")
def records(spark):
    return frame(spark, BOOK, ARTICLE, LONE, BARE).cache()


def cites(records, style):
    return {r["record_id"]: r["citation"] for r in cite.citations(extract(records), style).collect()}


def test_citations(records):
    apa, mla, chicago = (cites(records, x) for x in ("apa", "mla", "chicago"))
    a, b = ARTICLE["record_id"], BOOK["record_id"]
    doi = "https://doi.org/10.5555/arw.9.777"
    assert apa[a] == f"Okafor, L. M. & Brandt, T. K. (2023). Slow Rivers and Their Bridges. Annals of River Works, 76(3), 1-45. {doi}"
    assert apa[b] == "Harlow, I. T. (2012). Tidal Gardens: A Field Companion. Fen Press."
    assert mla[a] == f'Okafor, Lena M., and Brandt, Timo K.. "Slow Rivers and Their Bridges." Annals of River Works, vol. 76, no. 3, 2023, pp. 1-45. {doi}'
    assert chicago[a] == f'Okafor, Lena M., and Brandt, Timo K.. "Slow Rivers and Their Bridges." Annals of River Works 76, no. 3 (2023): 1-45. {doi}'
    assert apa["x2"] == "(). Only a title."
    assert cites(records, "nonsense") == apa
    bib, ris = cites(records, "bibtex"), cites(records, "ris")
    assert bib[a].startswith("@article{okafor2023slow,\n") and bib[b].startswith("@book{harlow2012tidal,\n") and bib[b].endswith("\n}")
    assert bib["x2"].startswith("@book{unknownYYYYonly,")
    assert ris[a].startswith("TY  - JOUR\nAU  - Okafor, Lena M.\nAU  - Brandt, Timo K.\n") and "SP  - 1\nEP  - 45" in ris[a] and ris[b].startswith("TY  - BOOK") and ris[b].endswith("ER  -")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 20, 21])
def test_author_counts(spark, n):
    r = BOOK | {"creator": [f"Name{i}, A B" for i in range(n)]}
    apa, mla, chicago = (cites(frame(spark, r), x)[BOOK["record_id"]] for x in ("apa", "mla", "chicago"))
    short = [f"Name{i}, A. B." for i in range(n)]
    full = [f"Name{i}, A B" for i in range(n)]
    want = "" if n == 0 else short[0] + " " if n == 1 else " & ".join(short) + " " if n == 2 else ", ".join(short[:-1]) + f", & {short[-1]} " if n <= 20 else ", ".join(short[:19]) + f", ... {short[-1]} "
    assert apa.startswith(want + "(2012).")
    assert mla.startswith({0: "Tidal", 1: "Name0, A B. ", 2: "Name0, A B, and Name1, A B. "}.get(n, "Name0, A B, et al. "))
    several = f"{', '.join(full[:-1])}, and {full[-1]}. " if n > 1 else ""
    assert chicago.startswith({0: "Tidal", 1: "Name0, A B. "}.get(n, several if n <= 3 else "Name0, A B, et al. "))


def test_links(records):
    rows = {r["record_id"]: r["l"] for r in records.select("record_id", links.bundle(F.col).alias("l")).collect()}
    a = rows[ARTICLE["record_id"]]
    assert (len(a["html_links"]), len(a["pdf_links"]), a["doi_url"], a["open_access"]) == (1, 1, "https://doi.org/10.5555/arw.9.777", True)
    assert rows[BOOK["record_id"]]["source_links"] == ["https://x.org/a.pdf"]


def test_metadata(records):
    m = {r["record_id"]: r for r in extract(records).collect()}
    assert m["x1"]["authors"] == ["Editor, Joe"] and m["x2"]["authors"] == [] and m["x2"]["date"] == ""
    assert m[BOOK["record_id"]]["resource_type"] == "book" and m[ARTICLE["record_id"]]["resource_type"] == "article"


def test_joined_authors(spark):
    base = {"record_id": "TN_cdi_1", "title": ["t"], "creator": ["A, B ; C, D"], "source": ["Base"], "jtitle": ["Journal"], "ad_date": ["2020-07-01"]}
    split, listed = extract(frame(spark, base)).first(), extract(frame(spark, base | {"au": ["A, B", "C, D", "E, F"]})).first()
    assert split["authors"] == ["A, B", "C, D"] and listed["authors"] == ["A, B", "C, D", "E, F"]
    assert (split["source"], split["date"], split["is_cdi"]) == ("Journal", "2020", True)


def test_scores(spark):
    a = {"record_id": "a", "title": ["Machine Learning Advances"], "creationdate": ["2025"], "type": ["article"], "doi": ["10.1/x"], "creator": ["A"], "availability": ["available"]}
    b = {"record_id": "b", "title": ["Introduction to Computing"], "creationdate": ["1995"], "type": ["book"], "creator": ["B"], "availability": [""]}
    got = {r["record_id"]: r["score"] for r in ranking.scored(frame(spark, a, b), "machine learning", 2026).collect()}
    assert got["a"] == pytest.approx(0.99) and got["b"] == pytest.approx(0.171)


def test_fusion(spark):
    def leg(*ids):
        return spark.createDataFrame([(x, [x], i) for i, x in enumerate(ids)], "record_id string, title array<string>, rank int")

    rows = ranking.fuse([leg("A", "B"), None, leg("B", "C")]).collect()
    assert [(r["fusion_key"], round(r["rrf"], 7)) for r in rows] == [("B", 0.0330601), ("A", 0.0166667), ("C", 0.0163934)]
    assert len(ranking.fuse([leg("A", "A")]).collect()) == 1 and len(ranking.fuse([leg("A", "B")], 1).collect()) == 1
    assert ranking.fusion_total([3, 9, 4]) == 9


def test_subjects(records):
    rows = stats.top_subjects(records.filter(F.col("record_id") == BOOK["record_id"]).withColumn("position", F.lit(0))).collect()
    assert [r["subject"] for r in rows] == BOOK["subject"]


@pytest.mark.parametrize(
    ("query", "texts"),
    [
        ("cat dog", [True, False, False, True]),
        ("cat OR dog", [True, True, True, True]),
        ("cat NOT dog", [False, True, False, False]),
        ('"cat dog"', [True, False, False, False]),
        ("c?t AND do*", [True, False, False, True]),
        ("(cat OR bird) NOT dog", [False, True, False, False]),
        ("cat and dog", [False, False, False, True]),
        ('"cat (dog', [True, False, False, True]),
        ("", [True] * 4),
        ("NOT cat", [False, False, True, False]),
    ],
)
def test_boolean(spark, query, texts):
    docs = spark.createDataFrame([(0, "Cat, dog"), (1, "cat scat"), (2, "dog cats"), (3, "dog and cat")], "i int, t string")
    got = docs.select("i", boolean.compile_tree(boolean.parse(query), [F.lower("t")]).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == texts


def test_sanitiser_twins(spark):
    from bibspark.functions.text import sanitized

    qs = ["a <b>c</b> $$Qd", " AND ".join(f"t{i}" for i in range(50)), "x  y", "(" * 30, "AND OR NOT " * 20]
    got = [r["s"] for r in spark.createDataFrame([(q,) for q in qs], "q string").select(sanitized(F.col("q")).alias("s")).collect()]
    assert got == [s.clean_query(q) for q in qs]


def test_expansion():
    assert s.expression("machine learning", "deep learning OR neural networks") == "(machine learning) OR (deep learning OR neural networks)"
    assert s.expression("a", "  ") == "a" and s.clamp(-3, 50) == 0 and s.clamp(99, 50) == 50


def _items(spark, records):
    rows = items(extract(records)).withColumn("key", F.concat(F.lit("K"), "record_id")).withColumn("collections", F.array(F.lit("COL1"))).withColumn("tags", F.array(F.lit("t"))).withColumn("num_children", F.lit(0))
    return rows


def test_duplicates(spark, records):
    lib = _items(spark, records)
    title = BOOK | {"record_id": "n1", "isbn": [], "creator": ["Harlow, I."]}
    other = BOOK | {"record_id": "n2", "isbn": [], "creator": ["Vance, C."]}
    isbn = BOOK | {"record_id": "n3", "title": ["Another"]}
    doi = ARTICLE | {"record_id": "n4", "title": ["Another"], "doi": [" 10.5555/ARW.9.777"]}
    got = {r["record_id"]: r["match_type"] for r in resolve.duplicates(extract(frame(spark, title, other, isbn, doi)), lib).collect()}
    assert got == {"n1": "title_author", "n2": "none", "n3": "isbn", "n4": "doi"}
    ids = resolve.id_list(spark, ["n2", "n3", "zz", "n2"])
    st = [r["status"] for r in resolve.save_statuses(ids, extract(frame(spark, other, isbn)), lib).orderBy("pos").collect()]
    assert st == ["saved", "skipped", "failed", "skipped"]
    assert "Key: K" in item_summary(item_rows(lib)).first()["summary"]


def test_without_pdf(spark):
    its = spark.createDataFrame([("A", "book"), ("B", "book"), ("C", "note")], "key string, item_type string")
    kids = spark.createDataFrame([("k1", "B", "attachment", "application/PDF")], "key string, parent_key string, item_type string, content_type string")
    assert [r["key"] for r in resolve.without_pdf(its, kids).collect()] == ["A"]


def test_collections(spark):
    c = spark.createDataFrame([("COL1", "Papers", None, 1), ("COL2", "papers", "PARENT1", 2)], "key string, name string, parent_key string, num_items int")
    assert resolve.find_collection(c, "PAPERS").first()["key"] == "COL1"
    assert resolve.find_collection(c, "Papers", "PARENT1").first()["key"] == "COL2"
    assert resolve.find_collection(c, "Papers", "none").first() is None
    new = spark.createDataFrame([("X", "Papers", None, 0), ("Y", "Other", None, 0)], c.schema)
    assert sorted(r["key"] for r in resolve.upsert_collection(c, new).collect()) == ["COL1", "COL2", "Y"]


def test_enrich(spark, records):
    m = extract(frame(spark, ARTICLE | {"creationdate": [""], "creator": []}, BOOK))
    registry = spark.createDataFrame([("10.5555/arw.9.777", ["R, S"], "2021", "J")], "doi string, authors array<string>, date string, source string")
    got = {r["record_id"]: r for r in resolve.enrich(m, registry).collect()}
    assert (got[ARTICLE["record_id"]]["date"], got[ARTICLE["record_id"]]["authors"], got[ARTICLE["record_id"]]["enriched"]) == ("2021", ["R, S"], True)
    assert got[BOOK["record_id"]]["enriched"] is False


def test_evaluation(spark):
    run = spark.createDataFrame([(1, i, d) for i, d in enumerate("xaab")], "query_id int, rank int, doc_key string")
    rel = spark.createDataFrame([(1, d) for d in "abc"], "query_id int, doc_key string")
    m = evaluation.metrics(run, rel, 10).first()
    assert (round(m["ndcg"], 6), m["mrr"], round(m["recall"], 6)) == (0.498189, 0.5, 0.666667)
    four = spark.createDataFrame([(float(i),) for i in (4, 2, 3, 1)], "v double")
    assert tuple(evaluation.exact_percentile(four, "v", None, 0.5, 0.95).first()) == (3.0, 4.0)
    r = random.Random(3)
    rows = [(r.choice("ab") if i % 3 else None, float(r.choice((1, 1, 1, 2, r.random() * 50))) if i % 50 else None) for i in range(3000)]
    got = {x["g"]: (x["p50"], x["p95"]) for x in evaluation.exact_percentile(spark.createDataFrame(rows, "g string, v double"), "v", "g", 0.5, 0.95).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (v[len(v) // 2], v[min(int(len(v) * 0.95), len(v) - 1)])
    assert evaluation.exact_percentile(four.limit(0), "v", None, 0.5).first()["p50"] is None
    assert evaluation.summary(spark.createDataFrame([], "ndcg double, mrr double, recall double, latency_ms double, error string")).first()["n_queries"] == 0


def test_exports(spark, records):
    docs = records.withColumn("position", F.when(F.col("record_id") == BOOK["record_id"], 0).otherwise(1)).filter("record_id like 'alma%'")
    csv = sinks.export(docs, "csv", "q", 1234).first()["output"].split("\n")
    assert csv[0] == "# CSV Export: 2 of 1,234 results for 'q'" and csv[1].startswith("record_id,title") and csv[2].startswith("alma990000004242,Tidal Gardens")
    js = sinks.export(docs, "json", "q", 2).first()["output"]
    assert js.startswith("// JSON Export: 2 of 2") and '"isbn" : "9781234567897"' in js
    assert sinks.export(docs, "bibtex", "q", 2).first()["output"].startswith("% BibTeX Export: 2 of 2 results for 'q'\n\n@book{harlow2012tidal,")
    assert sinks.export(docs, "nope", "q", 2).first()["output"] == "Unknown export format: nope"
    rep = sinks.report(docs, 2, "q").first()["output"]
    assert "1. Tidal Gardens: A Field Companion\n   Author: Harlow, Ines T.$$QHarlow, Ines T.\n" in rep and "Electronic resources available: 2\n" in rep
    assert "Top subjects across results: Tidal gardens, Salt plants, Coastal botany, Slow rivers\n" in rep
    assert "ITEM DETAILS" in sinks.detail(docs).first()["detail"]


def test_tools(spark, records):
    lib = api.Library(spark, records, _items(spark, records))
    assert len(api.TOOLS) >= 23
    assert [r["record_id"] for r in api.call(lib, "search_library", query="tidal gardens").collect()] == [BOOK["record_id"]]
    got = api.call(lib, "batch_generate_citations", record_ids=[BOOK["record_id"], "none", BOOK["record_id"]]).collect()
    assert [r["found"] for r in got] == [True, False, True] and got[1]["citation"].startswith("Unable")
    assert [r["found"] for r in api.call(lib, "batch_isbn_lookup", isbn_list=["978-1-234-56789-7", "1"]).collect()] == [True, False]
    assert api.call(lib, "search_by_author", author="brandt").first()["record_id"] == ARTICLE["record_id"]
    assert api.call(lib, "get_full_text_links", record_id=ARTICLE["record_id"]).first()["open_access"] is True
    with pytest.raises(KeyError):
        api.call(lib, "nothing")
    assert "unknown tool nothing" in api.dispatch(lib, "nothing").first()["error"]
    assert "Error in read_article" in api.dispatch(lib, "read_article", record_id="x").first()["error"]
    assert api.dispatch(lib, "search_by_subject", subject="rivers").first()["record_id"] == ARTICLE["record_id"]
    report = [(r["section"], r["line"]) for r in api.call(lib, "get_diagnostics").collect()]
    assert ("errors", "(log not found)") in report and sum(x.startswith("read_article: 1 calls, 1 errors") for _, x in report) == 1


def test_saving(spark, records):
    """Collections that are missing are made once, below their parent."""
    lib = api.Library(spark, records, _items(spark, records).filter("record_id = 'x1'"))
    out = api.call(lib, "batch_save_items", record_ids=[BOOK["record_id"], "none", BOOK["record_id"], "x1"], collection_name="Reading", parent_collection="Work").collect()
    assert [r["status"] for r in out] == ["saved", "failed", "skipped", "skipped"]
    made = {r["name"]: r for r in lib.collections.collect()}
    assert made["Reading"]["parent_key"] == made["Work"]["key"] and out[0]["collections"] == [made["Reading"]["key"]]
    counts = {r["status"]: r["n"] for r in api.call(lib, "save_counts", record_ids=["x2", "zz"], collection_name="READING", parent_collection="work").collect()}
    assert counts == {"saved": 1, "failed": 1} and lib.collections.count() == 2
    assert api.call(lib, "save_item", record_id="x2").first()["collections"] in (None, [])


def test_phrases_stay_in_a_value(spark):
    one = frame(spark, {"record_id": "p", "title": ["Red  green, blue"], "creator": ["Jane Smith", "Jane Brown"], "subject": ["red"]})
    for query, field, want in (('"smith jane"', "creator", 0), ('"jane smith"', "creator", 1), ('"red green"', "title", 1), ('"blue red"', "any", 0), ("smith brown", "creator", 1)):
        assert one.filter(s.matches(query, field)).count() == want, query


def test_rewriting(spark):
    def new(q, **d):
        args = {"abbreviations": {"REM": "Resource Management", "BC": "before"}, "synonyms": {"course reserves": ["short loans", "readings"]}, "preferred": {"Indigenous": ["Native", "First Nations"]}, "stops": ("bc",)} | d
        return spark.range(1).select(s.rewrite(F.lit(q), args["abbreviations"], args["synonyms"], args["preferred"], args["stops"]).alias("x")).first()["x"]

    assert new("rem thesis AND bc salmon") == '"Resource Management" thesis AND bc salmon'
    assert new("(Course Reserves) NOT first  nations") == '(("course reserves" OR "short loans" OR readings)) NOT Indigenous'
    assert new("remark natives", preferred={}) == "remark natives" and new("a OR b", abbreviations={}, synonyms={}, preferred={}) == "a OR b"


def test_readers_and_writers(spark, tmp_path):
    """Logs, evaluation queries, PDFs, embeddings and appended tables."""
    from bibspark.sources import tables

    (tmp_path / "log").write_text("a [ERROR] x\nINFO\nb WARNING y\n")
    assert [r["line"] for r in stats.last_errors(tables.log_lines(spark, str(tmp_path / "log"))).collect()] == ["a [ERROR] x", "b WARNING y"]
    assert [r["line"] for r in stats.last_errors(tables.log_lines(spark, str(tmp_path / "log")), strict=True).collect()] == ["b WARNING y"]
    (tmp_path / "q.json").write_text('[{"query": "a", "subject": "s", "difficulty": "easy", "seed_doi": "10.1/x"}, {"query": "b"}]')
    assert [tuple(r) for r in tables.eval_queries(spark, str(tmp_path / "q.json")).collect()] == [("a", "s", "easy", "10.1/x"), ("b", None, None, None)]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "bad.pdf").write_bytes(b"<html>")
    assert tables.pdf_texts(spark, str(tmp_path / "pdf")).first()["error"] == "no PDF"

    def embed(texts):
        if "bad" in texts:
            raise ValueError("no service")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "abc"), (3, "bad")], "id long, text string").coalesce(1)
    got = {r["id"]: (r["embedding"], r["error"]) for r in tables.embedding_batches(rows, embed, 2).collect()}
    assert got == {1: ([1.0], None), 2: ([3.0], None), 3: (None, "no service")}
    assert tables.wrap_embedding(spark.createDataFrame([(1, [2.0])], "id int, embedding array<double>")).first()["embeddings"] == [[2.0]]
    left = sinks.pdf_files(spark.createDataFrame([("u", bytearray(b"%PDF-1.4 x")), ("v", bytearray(b"no"))], "url string, content binary"), str(tmp_path / "store"))
    assert [tuple(r) for r in left.collect()] == [("v", "not a PDF")] and spark.read.parquet(str(tmp_path / "store")).count() == 1
    for _ in range(2):
        sinks.append(rows, str(tmp_path / "items"))
        sinks.append_json(rows, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "items")).count() == spark.read.json(str(tmp_path / "runs")).count() == 6


def test_enrichment_is_repeatable(spark):
    m = extract(frame(spark, ARTICLE | {"creationdate": [""], "creator": []}))
    registry = spark.createDataFrame([(ARTICLE["doi"][0], [f"R{i}"], f"20{i:02d}", "J") for i in range(20)], "doi string, authors array<string>, date string, source string")
    assert {resolve.enrich(m, registry.repartition(k)).first()["date"] for k in (1, 5, 9)} == {"2000"}


def test_settings():
    assert Settings().checked() == []
    odd = Settings.from_env({"BIBSPARK_KEY_BUDGET": "99", "BIBSPARK_FLAG_RERANK": "false"})
    assert odd.key_budget == 99 and odd.flags["rerank"] is False and len(odd.checked()) == 2
    wrong = Settings(max_retries=-1, refresh_buffer=-1, cache_ttl_seconds=-1, search_timeout=0.5, log_level="loud", cache_entries=0).checked()
    assert len(wrong) == 6 and len(Settings().credentials()) == 5
    assert read_env_file("# c\nA=1\nB = 'x y'\n\nbad") == {"A": "1", "B": "x y"}
