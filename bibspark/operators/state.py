"""Event analytics over keyed time: budgets, source classes, breakers, histories. Batch versions.

Events are replayed in order of (ts, event_id). Where a result hangs on earlier results of the same key (admission,
breaker), the key's events are folded in that order: they come in one sorted stream, of which only the state is held. Such
a machine can't be split, so a key's events are read by one task, in linear time; keys are dealt freely.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def window_counts(events: DataFrame, key: str | None = None, seconds: int = 3600, name: str = "in_window") -> DataFrame:
    """event_id and how many events of its key (of all, without one) stand in the trailing window, itself included; one
    exactly `seconds` old is out, and so are later ones of the same time.

    Time is cut to buckets of `seconds`. An event counts in its own and the next bucket, and a bucket of a key is
    counted by itself, so neither a hot key nor the whole table is ever in one task."""
    size = seconds * 1_000_000
    by = [F.col(key)] if key else []
    e = events.withColumn("micros", micros()).withColumn("bucket", F.floor(F.col("micros") / size))
    both = e.select("event_id", *by, "micros", "bucket", F.lit(True).alias("own")).unionByName(e.select("event_id", *by, "micros", (F.col("bucket") + 1).alias("bucket"), F.lit(False).alias("own")))
    w = Window.partitionBy(*by, "bucket").orderBy("micros").rangeBetween(-(size - 1), 0)
    later = F.row_number().over(Window.partitionBy(*by, "bucket", "micros").orderBy(F.desc("event_id"))) - 1
    return both.withColumn(name, F.count("*").over(w) - later).filter("own").select("event_id", name)


def budget_status(events: DataFrame, key: str, now_micros: int, limit: int, seconds: int = 3600) -> DataFrame:
    """used and remaining of each key with events in the window before a time."""
    inside = events.withColumn("micros", micros()).filter((F.col("micros") > now_micros - seconds * 1_000_000) & (F.col("micros") <= now_micros))
    return inside.groupBy(key).agg(F.count("*").alias("used")).withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)))


class Budget:
    """Session, hour and key budgets, checked in this order; only admitted events use them up."""

    def __init__(self, session: int = 15, hour: int = 20, key: int = 5, seconds: int = 3600):
        self.limits, self.span = (session, hour, key), seconds * 1_000_000
        self.n = 0
        self.of: dict[str, int] = {}
        self.admitted: deque[tuple[int, str]] = deque()  # in order of time

    def ask(self, at: int, key: str) -> str:
        """`ok`, or the budget that denies."""
        while self.admitted and self.admitted[0][0] <= at - self.span:  # keys without a time in the window are dropped
            old = self.admitted.popleft()[1]
            self.of[old] -= 1
            if not self.of[old]:
                del self.of[old]
        for name, used, limit in zip(("session", "hour", "key"), (self.n, len(self.admitted), self.of.get(key, 0)), self.limits, strict=True):
            if used >= limit:
                return name
        self.add(at, key)
        self.n += 1
        return "ok"

    def add(self, at: int, key: str) -> None:
        self.admitted.append((at, key))
        self.of[key] = self.of.get(key, 0) + 1


def admit(events: DataFrame, session: str, key: str, limits: tuple[int, int, int] = (15, 20, 5), seconds: int = 3600) -> DataFrame:
    """Exact admission of each session's events in order: event_id, session and decision. State is a session's; its
    events come in one sorted stream, of which only the window is held."""
    rows = events.select(F.col(session).alias("session"), F.col(key).cast("string").alias("key"), "event_id", micros().alias("micros"))
    kind = rows.schema["session"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget, current = None, object()
        for f in frames:
            out = []
            for s, k, at in zip(f["session"].tolist(), f["key"].tolist(), f["micros"].tolist(), strict=True):
                if budget is None or s != current:
                    budget, current = Budget(*limits, seconds), s
                out.append(budget.ask(at, k))
            yield pd.DataFrame({"event_id": f["event_id"], "session": f["session"], "decision": out})

    return rows.repartition("session").sortWithinPartitions("session", "micros", "event_id").mapInPandas(run, f"event_id long, session {kind}, decision string")


def source_class(direct_ok: Column, direct_failed: Column) -> Column:
    """A direct success decides for good, then a direct failure; other channels say nothing."""
    return F.when(F.coalesce(direct_ok, F.lit(False)), "DIRECT_OK").when(F.coalesce(direct_failed, F.lit(False)), "BROWSER_ONLY").otherwise("UNKNOWN")


def classify(events: DataFrame, key: str) -> DataFrame:
    """The class of each source. The order of events does not matter, so it sums up before the shuffle. events: tier, success."""
    direct = F.col("tier") == "direct"
    both = events.groupBy(key).agg(F.bool_or(direct & F.col("success")).alias("ok"), F.bool_or(direct & ~F.col("success")).alias("bad"))
    return both.select(key, source_class(F.col("ok"), F.col("bad")).alias("source_class"))


def classify_running(events: DataFrame, key: str) -> DataFrame:
    """The class after each event."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    direct = F.col("tier") == "direct"
    return events.withColumn("source_class", source_class(F.bool_or(direct & F.col("success")).over(w), F.bool_or(direct & ~F.col("success")).over(w)))


def tiers_seen(events: DataFrame, key: str) -> DataFrame:
    ok = F.when(F.col("success"), F.col("tier"))
    bad = F.when(~F.col("success"), F.col("tier"))
    return events.groupBy(key).agg(F.array_sort(F.collect_set(ok)).alias("succeeded"), F.array_sort(F.collect_set(bad)).alias("failed"))


def tier_order(tiers: Column, kind: Column) -> Column:
    """Direct tiers first, or browser tiers first for sources that need one; nothing is dropped, order within stays."""

    def browser(t: Column) -> Column:
        return t.contains("browser")

    last = F.concat(F.filter(tiers, browser), F.filter(tiers, lambda t: ~browser(t)))
    return F.when(kind == "BROWSER_ONLY", last).otherwise(F.concat(F.filter(tiers, lambda t: ~browser(t)), F.filter(tiers, browser)))


def failure_runs(events: DataFrame, key: str, least: int) -> DataFrame:
    """Runs of consecutive failures of at least a length: key, first and last event, length."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    e = events.withColumn("run", F.sum(F.when(F.col("success"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = e.filter(~F.col("success")).groupBy(key, "run").agg(F.count("*").alias("length"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
    return runs.filter(F.col("length") >= least).select(key, "first_event", "last_event", "length")


def breaker(events: DataFrame, key: str, threshold: int = 5, timeout: float = 60.0) -> DataFrame:
    """The state in which each event finds its key's breaker, and the one it leaves, in one sorted pass."""
    rows = events.select(F.col(key).alias("key"), "event_id", micros().alias("micros"), "success")
    kind = rows.schema["key"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, current = None, object()
        for f in frames:
            out = []
            for k, at, ok in zip(f["key"].tolist(), f["micros"].tolist(), f["success"].tolist(), strict=True):
                if b is None or k != current:
                    b, current = Breaker(threshold, timeout), k
                out.append(b.see(at, bool(ok)))
            yield pd.DataFrame({"key": f["key"], "event_id": f["event_id"], "before": [x for x, _ in out], "after": [x for _, x in out]})

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "micros", "event_id")
    return sorted_rows.mapInPandas(run, f"key {kind}, event_id long, before string, after string").withColumnRenamed("key", key)


class Breaker:
    """The machine: a number of failures in a row opens it, a time later one call is let through."""

    def __init__(self, threshold: int = 5, timeout: float = 60.0):
        self.threshold, self.timeout = threshold, int(timeout * 1e6)
        self.state, self.failures, self.opened = "CLOSED", 0, 0

    def see(self, at: int, ok: bool) -> tuple[str, str]:
        before = "HALF_OPEN" if self.state == "OPEN" and at - self.opened >= self.timeout else self.state
        if before == "OPEN":
            return before, before
        self.failures = 0 if ok else self.failures + 1
        after = "CLOSED" if ok else "OPEN" if self.failures >= self.threshold else before
        if after == "OPEN":
            self.opened = at
        self.state = after
        return before, after


def recent_records(seen: DataFrame, kept: int = 500) -> DataFrame:
    """The last records by first sight; seeing one again does not move it. seen: record_id, seq."""
    firsts = seen.groupBy("record_id").agg(F.min("seq").alias("first_seen"))
    return firsts.orderBy(F.desc("first_seen"), "record_id").limit(kept)


def first_wins(rows: DataFrame, key: Iterable[str], *order: str) -> DataFrame:
    """One row per key, the first by order."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def history(captures: DataFrame, shown: int = 50) -> DataFrame:
    """The newest captures that were not turned away."""
    return captures.filter("recorded").orderBy(F.desc("ts"), F.desc("event_id")).limit(shown)
