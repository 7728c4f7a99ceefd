"""Every query against its SQL on the smallest tables, and plans that must hold at scale."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from bibspark import oracle, queries
from bibspark.plans import search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows, "a comparison of nothing"
    cur = duck.execute(oracle.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    want = sorted(tuple(plain(float(r[i])) if hasattr(r[i], "as_tuple") else plain(r[i]) for i in order) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows)
    assert got == want


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_search_plan(spark):
    docs = queries._catalog(spark, SF)
    p = plan(search.search(docs, search.Search("the of")))
    assert "TakeOrderedAndProject" in p and "Python" not in p and "CartesianProduct" not in p


def test_scan_prunes(spark):
    p = plan(queries.electronic_count(spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in p


def test_pushdown(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_quantity > 40").agg(F.count("*"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan(df)


def test_duplicates_plan(spark):
    """Narrow tables are read, not the catalogue again for each test."""
    p = queries.dup_cascade_status(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan") <= 15 and "documents.parquet" not in p and "CartesianProduct" not in p


def test_no_python_in_core(spark):
    for name in ("signal_scores", "metadata_extract", "cite_apa", "dup_cascade_status", "budget_windows", "eval_summary"):
        assert "Python" not in plan(queries.QUERIES[name](spark, SF)), name
