"""Event state: rules by hand, batch against a plain fold, and streams against batch."""

import datetime as dt

import pytest

from bibspark import queries
from bibspark.operators import state
from bibspark.streaming import stateful

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def events(spark, rows):
    data = [(i, T0 + dt.timedelta(seconds=s), k, tier, ok) for i, (s, k, tier, ok) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, ts timestamp, key string, tier string, success boolean")


def test_window_edge(spark):
    e = events(spark, [(0, "a", "x", True), (3600, "a", "x", True), (3600.5, "a", "x", True)])
    assert [r["in_window"] for r in state.window_counts(e, "key").orderBy("event_id").collect()] == [1, 1, 2]
    assert [r["in_window"] for r in state.window_counts(e).orderBy("event_id").collect()] == [1, 1, 2]


def test_budget():
    b = state.Budget(3, 5, 2)
    assert [b.ask(i, k) for i, k in enumerate("aaab")] == ["ok", "ok", "key", "ok"]
    assert b.ask(9, "c") == "session"
    old = state.Budget(9, 1, 1)
    assert (old.ask(0, "a"), old.ask(3599999999, "a"), old.ask(3600000000, "a")) == ("ok", "hour", "ok")


@pytest.mark.parametrize(
    ("rows", "kind"),
    [([("direct", False), ("direct", True)], "DIRECT_OK"), ([("direct", True), ("direct", False)], "DIRECT_OK"), ([("browser", True)], "UNKNOWN"), ([("direct", False)], "BROWSER_ONLY")],
)
def test_classes(spark, rows, kind):
    e = events(spark, [(i, "a", t, ok) for i, (t, ok) in enumerate(rows)])
    assert state.classify(e, "key").first()["source_class"] == kind
    assert state.classify_running(e, "key").orderBy("event_id").collect()[-1]["source_class"] == kind


def test_breaker(spark):
    rows = [(0, False), (1, False), (2, True), (70, True), (71, False), (72, False), (140, False), (150, True)]
    e = events(spark, [(s, "a", "x", ok) for s, ok in rows])
    got = [(r["before"], r["after"]) for r in state.breaker(e, "key", 2, 60.0).orderBy("event_id").collect()]
    b = state.Breaker(2, 60.0)
    assert got == [b.see(s * 1_000_000, ok) for s, ok in rows]
    assert got[1:4] == [("CLOSED", "OPEN"), ("OPEN", "OPEN"), ("HALF_OPEN", "CLOSED")] and got[6] == ("HALF_OPEN", "OPEN")


def test_runs_and_recent(spark):
    e = events(spark, [(i, "a", "x", ok) for i, ok in enumerate([True, False, False, False, True, False])])
    r = state.failure_runs(e, "key", 3).collect()
    assert [(x["first_event"], x["last_event"], x["length"]) for x in r] == [(1, 3, 3)]
    seen = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "record_id string, seq long")
    assert [x["record_id"] for x in state.recent_records(seen, 2).collect()] == ["c", "b"]


def test_ties_in_a_window(spark):
    e = events(spark, [(0, "a", "x", True)] * 3 + [(5, "a", "x", True)])
    assert [r["in_window"] for r in state.window_counts(e, "key").orderBy("event_id").collect()] == [1, 2, 3, 4]


def test_budget_forgets_keys():
    b = state.Budget(10**9, 10**9, 10**9, 10)
    for i in range(1000):
        assert b.ask(i * 1_000_000, f"k{i}") == "ok"
    assert len(b.of) <= 10 and len(b.admitted) <= 10


def test_breaker_is_linear(spark):
    """One key of many events."""
    import time

    e = spark.range(32_000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "'k' AS key", "id % 7 > 2 AS success")
    state.breaker(e.limit(10), "key").collect()
    began = time.perf_counter()
    got = state.breaker(e, "key", 3, 60.0).collect()
    assert len(got) == 32_000 and time.perf_counter() - began < 10
    b = state.Breaker(3, 60.0)
    assert [(r["before"], r["after"]) for r in sorted(got, key=lambda r: r["event_id"])] == [b.see((1704067200 + i) * 1_000_000, i % 7 > 2) for i in range(32_000)]


def test_router_stream_equals_batch(spark):
    a, b = queries.stream_router(spark, SF), queries.router_state(spark, SF)
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


@pytest.mark.parametrize("kind", ["budget", "breaker"])
def test_streams_take_events_out_of_order(spark, tmp_path, kind):
    """Files whose events overlap in time, one file a batch: what the watermark has passed equals the batch version; what
    comes later than the watermark is dropped."""
    import random

    r = random.Random(5)
    rows = [(i, T0 + dt.timedelta(seconds=90 * i), r.choice("ab"), r.choice("xy"), r.random() < 0.5) for i in range(300)]
    schema = "event_id long, ts timestamp, user string, event_type string, success boolean"
    # batches of 60; each event up to 30 minutes late, so that neighbours overlap
    late = sorted(rows, key=lambda x: x[0] + r.randrange(20))
    for k in range(5):
        spark.createDataFrame(late[60 * k : 60 * k + 60], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in{k}")
    late_one = (999, T0, "a", "x", False)
    spark.createDataFrame([late_one], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in5")
    import os
    import shutil
    import time

    os.makedirs(f"{tmp_path}/all")
    for k in range(6):
        for n, f in enumerate(sorted(x for x in os.listdir(f"{tmp_path}/in{k}") if x.endswith(".parquet"))):
            shutil.copy(f"{tmp_path}/in{k}/{f}", f"{tmp_path}/all/{k}-{n}.parquet")
            os.utime(f"{tmp_path}/all/{k}-{n}.parquet", (time.time() + 10 * k - 1000, time.time() + 10 * k - 1000))
    stream = stateful.read_events(spark, f"file://{tmp_path}/all", spark.createDataFrame(rows[:1], schema).schema)
    every = spark.createDataFrame(rows, schema)
    if kind == "budget":
        out, want = stateful.admissions(stream, "user", "event_type", (40, 4, 2), 3600, "1 hour"), state.admit(every, "user", "event_type", (40, 4, 2), 3600)
    else:
        out, want = stateful.breakers(stream, "user", 2, 600.0, "1 hour"), state.breaker(every, "user", 2, 600.0).withColumnRenamed("user", "key")
    stateful.run_once(out, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    passed = {i for i, ts, *_ in rows if ts < rows[-1][1] - dt.timedelta(hours=1)}
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(tuple(x) for x in want.select(cols).collect() if x["event_id"] in passed)
    assert len(passed) > 200


def test_admission_equals_fold(spark):
    e = queries._events(spark, SF)
    rows = e.selectExpr("user_id", "unix_micros(ts) us", "event_id", "event_type").collect()
    budgets, want = {}, {}
    for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
        want[r["event_id"]] = budgets.setdefault(r["user_id"], state.Budget(15, 3, 2, 86400)).ask(r["us"], r["event_type"])
    got = {r["event_id"]: r["decision"] for r in queries.budget_admission(spark, SF).collect()}
    assert got == want and len(set(got.values())) > 1
