"""Streams of file changes: bursts of a path become one change, changes become upserts and deletes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import file_changes, latest
from ..scratch import staged
from ..sources.records import Table


def bursts(events: DataFrame, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """path, event_type, n and last_seen of each burst of a stream of path, event_type and ts: the last event counts."""
    w = F.session_window("ts", quiet)
    out = events.withWatermark("ts", late).groupBy("path", w.alias("burst")).agg(F.max_by("event_type", "ts").alias("event_type"), F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    return out.select("path", "event_type", "n", "last_seen")


def windows(events: DataFrame, by: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of `value` in tumbling or sliding windows, with late rows up to `late`."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def apply_changes(changes: DataFrame, table: Table, order: list[str], checkpoint: str, available_now: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Each batch of a stream of rows with the table's key and `deleted` goes into the table: of a key the last row by
    `order`, be it a deletion or not. A batch that comes twice changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        table.change(latest(rows, table.key, order), F.col("deleted"), f"s{number:020d}")

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def snapshots(spark: SparkSession, roots: list[str], seen: Table, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 minutes", **globs) -> StreamingQuery:
    """Looks at the files under the roots at every tick, and hands what changed since the last look to `work`, with the
    tick's number: path, change (created, modified or deleted) and action (index or remove). What was handed on is told
    to `seen`, a table by path, once work has ended, so a tick that fails is looked at again. With the files at hand this
    is the reconciliation too: nothing that was missed stays missed."""
    from ..sources import files

    def tick(_: DataFrame, number: int) -> None:
        found = files.discover(spark, roots, **globs).select("path", "file_path", "modified_time", "size")
        before = seen.read()
        changed = staged(file_changes(before if before is not None else found.limit(0), found), "file-changes")
        if not changed.isEmpty():
            work(changed, number)
            seen.change(changed.select("path", "file_path", "modified_time", "size", "action"), F.col("action") == "remove")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def intents(events: DataFrame, timeout: str = "60 seconds") -> DataFrame:
    """key, state and attempts of work, kept per key by a stream of key, state and ts; a claim that lasts longer than `timeout` is pending again."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    seconds = pd.Timedelta(timeout).total_seconds()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, attempts, at = state.get if state.exists else ("", 0, 0)
        if state.hasTimedOut:
            state.update(("pending", attempts, at))
            yield pd.DataFrame({"key": [key[0]], "state": ["pending"], "attempts": [attempts]})
            return
        for frame in frames:
            for r in frame.sort_values("ts").itertuples(index=False):
                current, attempts, at = r.state, attempts + (r.state == "claimed"), int(r.ts.timestamp() * 1000)
        state.update((current, attempts, at))
        if current in ("claimed", "running"):
            state.setTimeoutTimestamp(max(at + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "state": [current], "attempts": [attempts]})

    return events.withWatermark("ts", "1 second").groupBy("key").applyInPandasWithState(step, "key string, state string, attempts int", "state string, attempts int, at long", "update", GroupStateTimeout.EventTimeTimeout)


QUIET_STATE = "event_type string, n long, last_seen timestamp, due long"


def quiet_paths(events: DataFrame, quiet_seconds: float = 1.0) -> DataFrame:
    """path, event_type, n and last_seen of each burst of a stream of path, event_type and ts, once the path was quiet.

    A timer of the clock tells a path after its cooldown, though nothing else comes; each event of the path sets it anew.
    Of a burst the last event by ts counts. State is one row a path, and goes when it is told. The stream's update mode and
    its checkpoint carry it: timers that fall due while the stream is down fire when it is up again. Needs the state
    store with timers, which is set here."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    wait = int(quiet_seconds * 1000)

    class Burst(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getValueState("burst", QUIET_STATE)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            kind, n, seen, due = self.held.get() if self.held.exists() else (None, 0, None, None)
            if due is not None:
                self.handle.deleteTimer(due)
            for frame in rows:
                last = frame.sort_values("ts", kind="stable").iloc[-1]
                n += len(frame)
                if seen is None or last["ts"].to_pydatetime() >= seen:
                    kind, seen = last["event_type"], last["ts"].to_pydatetime()
            due = timerValues.getCurrentProcessingTimeInMs() + wait
            self.held.update((kind, n, seen, due))
            self.handle.registerTimer(due)
            yield pd.DataFrame()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            if not self.held.exists():
                return
            kind, n, seen, _ = self.held.get()
            self.held.clear()
            yield pd.DataFrame({"path": [key[0]], "event_type": [kind], "n": [n], "last_seen": [pd.Timestamp(seen)]})

        def close(self) -> None:
            pass

    conf = events.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = events.select("path", "event_type", "ts").groupBy("path")
    return grouped.transformWithStateInPandas(Burst(), "path string, event_type string, n long, last_seen timestamp", "update", "processingTime")
