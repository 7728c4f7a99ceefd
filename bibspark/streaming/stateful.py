"""Streams of events: budgets, source classes, breakers and first sights.

Event time with a watermark; rows later than that are dropped. Keyed folds take events in order of (ts, event_id)
whatever the order they come in: an event waits in its key's state until the watermark has passed it, so its result
is final when it is written, and equals the batch version's. A key without events for `idle` is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import Breaker, Budget, micros, source_class


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, ts as timestamp."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by key and tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), key).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def classes(events: DataFrame, key: str) -> DataFrame:
    """The class of each source so far, in update mode."""
    direct = F.col("tier") == "direct"
    both = events.groupBy(key).agg(F.bool_or(direct & F.col("success")).alias("ok"), F.bool_or(direct & ~F.col("success")).alias("bad"))
    return both.select(key, source_class(F.col("ok"), F.col("bad")).alias("source_class"))


def first_sights(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


class _Waiting:
    """Events of a key that the watermark has not passed: lists of times, ids and values."""

    def __init__(self, times=(), ids=(), values=()):
        self.rows = list(zip(times, ids, values, strict=True))

    def add(self, frames: Iterator[pd.DataFrame], value: str) -> None:
        for f in frames:
            self.rows += zip(f["micros"].tolist(), f["event_id"].tolist(), f[value].tolist(), strict=True)

    def due(self, watermark_ms: int) -> list[tuple]:
        """The events before the watermark, in order; they wait no longer."""
        self.rows.sort(key=lambda r: r[:2])
        k = next((i for i, r in enumerate(self.rows) if r[0] >= watermark_ms * 1000), len(self.rows))
        out, self.rows = self.rows[:k], self.rows[k:]
        return out

    def lists(self) -> tuple[list, list, list]:
        return [r[0] for r in self.rows], [r[1] for r in self.rows], [r[2] for r in self.rows]


def _wake(state, waiting: _Waiting, last: int, idle: int) -> None:
    """Calls the key again when the watermark has passed its first waiting event, or when it has been idle."""
    at = waiting.rows[0][0] // 1000 + 1 if waiting.rows else last // 1000 + idle * 1000
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def admissions(events: DataFrame, session: str, key: str, limits: tuple[int, int, int] = (15, 20, 5), seconds: int = 3600, late: str = "1 hour", idle: int = 30 * 86400) -> DataFrame:
    """Exact budget decisions of each session: event_id, session, decision. State: the admitted times in the window, and the
    events that wait for the watermark."""
    timed = events.withWatermark("ts", late)
    rows = timed.select("ts", F.col(session).alias("session"), F.col(key).cast("string").alias("key"), "event_id", micros().alias("micros"))
    kind = rows.schema["session"].dataType.simpleString()

    def step(group, frames, state):
        budget, waiting, last = Budget(*limits, seconds), _Waiting(), 0
        if state.exists:
            budget.n, times, keys, *held, last = state.get
            for t, k in zip(times, keys, strict=True):
                budget.add(t, k)
            waiting = _Waiting(*held)
        expired = state.hasTimedOut
        if not expired:
            waiting.add(frames, "key")
        due = waiting.due(state.getCurrentWatermarkMs())
        if expired and not due and not waiting.rows:
            state.remove()
            return
        out = [budget.ask(at, k) for at, _, k in due]
        last = max([last, *(r[0] for r in due)])
        state.update((budget.n, [t for t, _ in budget.admitted], [k for _, k in budget.admitted], *waiting.lists(), last))
        _wake(state, waiting, last, idle)
        if due:
            yield pd.DataFrame({"event_id": [i for _, i, _ in due], "session": group[0], "decision": out})

    kept = "n int, times array<long>, keys array<string>, at array<long>, ids array<long>, held array<string>, last long"
    return rows.groupBy("session").applyInPandasWithState(step, f"event_id long, session {kind}, decision string", kept, "append", "EventTimeTimeout")


def breakers(events: DataFrame, key: str, threshold: int = 5, timeout: float = 60.0, late: str = "1 hour", idle: int = 30 * 86400) -> DataFrame:
    """key, event_id, and the states that the event finds and leaves."""
    timed = events.withWatermark("ts", late)
    rows = timed.select("ts", F.col(key).alias("key"), "event_id", micros().alias("micros"), "success")
    kind = rows.schema["key"].dataType.simpleString()

    def step(group, frames, state):
        b, waiting, last = Breaker(threshold, timeout), _Waiting(), 0
        if state.exists:
            b.state, b.failures, b.opened, *held, last = state.get
            waiting = _Waiting(*held)
        expired = state.hasTimedOut
        if not expired:
            waiting.add(frames, "success")
        due = waiting.due(state.getCurrentWatermarkMs())
        if expired and not due and not waiting.rows:
            state.remove()
            return
        seen = [b.see(at, bool(ok)) for at, _, ok in due]
        last = max([last, *(r[0] for r in due)])
        state.update((b.state, b.failures, b.opened, *waiting.lists(), last))
        _wake(state, waiting, last, idle)
        if due:
            yield pd.DataFrame({"key": group[0], "event_id": [i for _, i, _ in due], "before": [x for x, _ in seen], "after": [x for _, x in seen]})

    kept = "state string, failures int, opened long, at array<long>, ids array<long>, held array<boolean>, last long"
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, event_id long, before string, after string", kept, "append", "EventTimeTimeout")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; results go to Parquet files."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Update-mode results: each batch's changed rows are appended with its number; the last one per key holds."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
