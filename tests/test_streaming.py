from __future__ import annotations

import datetime as dt
import time

import pytest

from tidewell.sources.records import Table
from tidewell.streaming import changes

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema):
        (tmp_path / "in").mkdir(exist_ok=True)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))

    return make


def drained(spark, frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        q.stop()


def test_bursts(spark, stream):
    rows = [("a", "created", at(0)), ("a", "modified", at(0.4)), ("a", "deleted", at(5)), ("b", "created", at(1)), ("z", "created", at(100))]
    events = stream(rows, "path string, event_type string, ts timestamp")
    got = drained(spark, changes.bursts(events), "bursts_seen", "append")
    assert sorted(r[:3] for r in got) == [("a", "deleted", 1), ("a", "modified", 2), ("b", "created", 1)]


def test_windows(spark, stream):
    events = stream([("a", 1.0, at(0)), ("a", 2.0, at(30)), ("a", 4.0, at(70)), ("a", 0.0, at(9000))], "kind string, value double, ts timestamp")
    got = drained(spark, changes.windows(events, "kind", "1 minute", late="1 minute"), "windows_seen", "append")
    assert sorted((r[2], r[3]) for r in got) == [(1, 4.0), (2, 3.0)]


def test_apply_changes(spark, stream, tmp_path):
    table = Table(spark, f"file://{tmp_path}/table", ["path"])
    rows = [("a", "1", False, at(0)), ("b", "2", False, at(0)), ("b", None, True, at(1)), ("b", "3", False, at(2)), ("c", None, True, at(0)), ("d", "4", False, at(0)), ("d", None, True, at(1))]
    events = stream(rows, "path string, body string, deleted boolean, ts timestamp")
    q = changes.apply_changes(events, table, ["ts"], str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted((r["path"], r["body"]) for r in table.read().collect()) == [("a", "1"), ("b", "3")]


def test_snapshots(spark, tmp_path):
    """Files that come, change and go are handed on once, and again if the work fails."""
    (tmp_path / "files").mkdir()
    for name in ("a.md", "b.md", "skip.bin"):
        (tmp_path / "files" / name).write_text(name)
    seen, told, fail = Table(spark, f"file://{tmp_path}/seen", ["path"]), [], [True]

    def work(changed, number):
        if fail:
            fail.clear()
            raise RuntimeError("not yet")
        told.append(sorted((r["file_path"], r["change"], r["action"]) for r in changed.collect()))

    def look():
        q = changes.snapshots(spark, [str(tmp_path / "files")], seen, work, str(tmp_path / "ck"), "1 second", include=["**/*.md"])
        try:
            for _ in range(90):
                if told or q.exception():
                    break
                time.sleep(0.5)
        finally:
            q.stop()
        return told.pop() if told else None

    assert look() is None
    assert look() == [("a.md", "created", "index"), ("b.md", "created", "index")]
    (tmp_path / "files" / "a.md").write_text("longer than before")
    (tmp_path / "files" / "b.md").unlink()
    assert look() == [("a.md", "modified", "index"), ("b.md", "deleted", "remove")]


def test_intents(spark, stream):
    rows = [("k", "pending", at(0)), ("k", "claimed", at(1)), ("j", "claimed", at(1)), ("j", "succeeded", at(2))]
    got = drained(spark, changes.intents(stream(rows, "key string, state string, ts timestamp")), "intents_seen", "update")
    assert ("j", "succeeded", 1) in got and ("k", "claimed", 1) in got


def test_quiet_paths(spark, stream):
    """One event and none after it: the path is told after its cooldown. A burst is told once, with its last event."""
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    events = stream([("a", "created", at(0)), ("a", "modified", at(3)), ("a", "renamed", at(2)), ("b", "deleted", at(1))], "path string, event_type string, ts timestamp")
    q = changes.quiet_paths(events, 0.5).writeStream.format("memory").queryName("quiet_seen").outputMode("update").start()
    try:
        for _ in range(240):
            got = sorted((r["path"], r["event_type"], r["n"], r["last_seen"]) for r in spark.table("quiet_seen").collect())
            if len(got) >= 2 or q.exception():
                break
            time.sleep(0.25)
        assert q.exception() is None
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    assert got == [("a", "modified", 3, at(3)), ("b", "deleted", 1, at(1))]
