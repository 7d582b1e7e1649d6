"""Outbox, dispatcher, listings and kept reports, over failures and restarts."""

import os
import time

import pytest
from pyspark.sql import functions as F
from quillstone.plans import commits
from quillstone.sources.vault import walk  # noqa: F401
from quillstone.streaming import dispatcher as D
from quillstone.streaming.outbox import InvalidEvent, Outbox, transactional

EVENT = "sequence long, event_id string, event_type string, aggregate_id string, payload string, schema_version int"


def events(spark, rows):
    return spark.createDataFrame([(*r, "{}", 1)[:6] if len(r) == 4 else r for r in rows], EVENT)


def test_outbox_shows_all_or_nothing(spark, tmp_path, monkeypatch):
    box = Outbox(spark, str(tmp_path / "box"))
    effect = spark.createDataFrame([("e1", "done")], "event_id string, what string")
    one = events(spark, [(1, "e1", "memory.committed", "a"), (2, "e1", "memory.committed", "a"), (3, "e2", "memory.committed", "b")])
    real = commits.Folder.write
    monkeypatch.setattr(commits.Folder, "write", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        box.emit(1, {"effects": effect}, one)
    assert box.read("effects") is None and box.read("events") is None
    monkeypatch.setattr(commits.Folder, "write", real)
    assert box.emit(1, {"effects": effect}, one)
    seen = lambda: (sorted(map(tuple, box.read("effects").select("event_id", "what").collect())), sorted(r.event_id for r in box.read("events").collect()))
    assert seen() == ([("e1", "done")], ["e1", "e2"])
    assert not box.emit(1, {"effects": effect}, one) and seen() == ([("e1", "done")], ["e1", "e2"])
    # The same events under another number: neither they nor their effects stand twice.
    assert box.emit(2, {"effects": effect.union(spark.createDataFrame([("e3", "new")], effect.schema))}, events(spark, [(4, "e1", "x", "a"), (5, "e3", "x", "c")]))
    assert seen() == ([("e1", "done"), ("e3", "new")], ["e1", "e2", "e3"])


def test_outbox_stops_at_the_first_invalid_event(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"))
    effect = spark.createDataFrame([("e1", "done")], "event_id string, what string")
    for bad in ((2, "e2", "", "b"), (2, "e2", "kind", None), (2, None, "kind", "b"), (2, "e2", "kind", "b", "x" * ((1 << 20) + 1), 1)):
        with pytest.raises(InvalidEvent, match="batch 1, event 2"):
            box.emit(1, {"effects": effect}, events(spark, [(1, "e1", "kind", "a"), (3, "e3", "", "a")]).union(events(spark, [bad])))
    assert box.committed() == [] and box.read("events") is None


def test_outbox_stream_over_a_restart(spark, tmp_path, monkeypatch):
    box, folder = Outbox(spark, str(tmp_path / "box")), str(tmp_path / "in")
    events(spark, [(1, "e1", "kind", "a"), (2, "e2", "kind", "b")]).coalesce(1).write.parquet(folder)

    def work(batch):
        return {"effects": batch.select("event_id", F.lit("done").alias("what"))}, batch

    def run():
        transactional(spark.readStream.schema(EVENT).parquet(folder), box, work, str(tmp_path / "checkpoint")).start().awaitTermination()

    real = commits.Folder.write
    monkeypatch.setattr(commits.Folder, "write", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        run()
    assert box.read("effects") is None
    monkeypatch.setattr(commits.Folder, "write", real)
    run()
    events(spark, [(3, "e3", "kind", "a"), (4, "e2", "kind", "b")]).coalesce(1).write.mode("append").parquet(folder)
    run()
    run()
    assert sorted(r.event_id for r in box.read("events").collect()) == ["e1", "e2", "e3"] == sorted(r.event_id for r in box.read("effects").collect())


def drained(frame, sink, checkpoint):
    """Runs a stream over all there is into a Parquet folder."""
    frame.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def runs(frame, sink, checkpoint, until):
    """Runs a stream with timers, which has no end of its own, until something holds, for a minute at most."""
    q = frame.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        begun = time.time()
        while time.time() < begun + 60 and not until(q):
            time.sleep(0.5)
    finally:
        q.stop()


def test_dispatcher(spark, tmp_path):
    D.use_rocksdb(spark)
    folder, sink, checkpoint, calls = (str(tmp_path / x) for x in ("in", "out", "checkpoint", "calls"))
    os.makedirs(calls)

    def told(name):
        def handle(event):
            n = len([f for f in os.listdir(calls) if f.startswith(f"{name}-{event['event_id']}-")])
            open(f"{calls}/{name}-{event['event_id']}-{n}", "w").close()
            if name == "flaky" and event["event_id"] == "e1" and n < 2:
                raise ValueError("not yet")
            if name == "picky" and event["event_id"] == "e2":
                raise D.Rejected("no thanks")

        return handle

    subscribers = [D.Subscriber("all", told("all")), D.Subscriber("flaky", told("flaky"), pending=1), D.Subscriber("picky", told("picky"), ["memory.*"])]
    events(spark, [(1, "e1", "memory.committed", "a"), (2, "e2", "memory.committed", "b"), (3, "e3", "graph.changed", "c"), (4, "e4", "memory.committed", "d", "{}", 99)]).coalesce(1).write.parquet(folder)
    stream = lambda: D.delivered(spark.readStream.schema(EVENT).parquet(folder), subscribers, base=300, cap=600)
    seen = lambda: {(r.subscriber, r.event_id): (r.outcome, r.attempts, (r.acked_at or "").partition("|")[2]) for r in spark.read.schema(D.DELIVERED).parquet(sink).where("outcome <> 'failed'").collect()}
    runs(stream(), sink, checkpoint, lambda q: os.path.exists(sink) and len(seen()) == 12)
    got = seen()
    assert got["all", "e1"] == got["all", "e2"] == got["all", "e3"] == ("acked", 1, "")
    assert all(got[s, "e4"] == ("rejected", 0, "unsupported_schema") for s in ("all", "flaky", "picky")[:2]) and got["picky", "e4"][0] == "rejected"
    assert got["flaky", "e1"] == ("acked", 3, "") and got["flaky", "e2"] == ("acked", 1, "") and got["flaky", "e3"] == ("acked", 1, "")
    assert got["picky", "e2"] == ("rejected", 1, "no thanks") and got["picky", "e3"] == ("rejected", 0, "pattern_mismatch")
    # One event may wait for another try: the rest were called after it had been taken.
    assert not [f for f in os.listdir(calls) if "e4" in f] and not [f for f in os.listdir(calls) if f.startswith("picky-e3")]
    before = sorted(os.listdir(calls))
    runs(stream(), sink, checkpoint, lambda q: len(q.recentProgress) > 1)  # a restart delivers nothing again
    assert sorted(os.listdir(calls)) == before and seen() == got
    events(spark, [(5, "e5", "memory.committed", "a")]).coalesce(1).write.mode("append").parquet(folder)
    runs(stream(), sink, checkpoint, lambda q: len(seen()) == 15)
    assert seen()["all", "e5"] == ("acked", 1, "") and {r.projection_name: r.last_sequence for r in D.cursors(spark.read.schema(D.DELIVERED).parquet(sink)).collect()} == {"all": 5, "flaky": 5, "picky": 5}


def test_pauses():
    found = [D.pause(n, "e") for n in range(1, 30)]
    assert all(1000 <= p <= 360_000 for p in found) and found == [D.pause(n, "e") for n in range(1, 30)] and found[-1] >= 240_000
    assert all(abs(p / (1000 * 2**n) - 1) <= 0.21 for n, p in enumerate(found[:8])) and D.pause(3, "e") != D.pause(3, "f")


def test_changes_between_listings(spark, tmp_path):
    D.use_rocksdb(spark)
    folder, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    files = lambda rows: spark.createDataFrame(rows, "path string, mtime long, size long")
    scans = [[("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], [("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], [("a", 1, 9), ("b", 2, 1), ("d", 1, 1)], [], [("a", 5, 5)]]
    kind = D.listing(files(scans[0]), 0).schema
    stream = lambda: D.changed(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder))
    seen = lambda: sorted((r.scan, r.path, r.event) for r in spark.read.schema("scan long, path string, event string, mtime long, size long").parquet(sink).collect())
    for n, rows in enumerate(scans[:3]):
        D.listing(files(rows), n).coalesce(1).write.mode("append").parquet(folder)
    drained(stream(), sink, checkpoint)
    first = [(1, "b", "MODIFY"), (1, "c", "DELETE"), (1, "d", "CREATE"), (2, "a", "MODIFY")]
    assert seen() == first
    drained(stream(), sink, checkpoint)
    assert seen() == first  # a restart emits nothing twice
    for n, rows in ((3, scans[3]), (4, scans[4])):
        D.listing(files(rows), n).coalesce(1).write.mode("append").parquet(folder)
        drained(stream(), sink, checkpoint)
    assert seen() == first + [(3, "a", "DELETE"), (3, "b", "DELETE"), (3, "d", "DELETE"), (4, "a", "CREATE")]


def test_reports_are_kept_for_a_time(spark, tmp_path):
    made, clock = [], [100.0]

    def make():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    ask = lambda: (lambda r: (r[0].first().n, r[1]))(commits.reused(spark, str(tmp_path), "stale", 60, make, lambda: clock[0]))
    assert ask() == (1, False) and ask() == (1, True)
    clock[0] = 159.0
    assert ask() == (1, True)
    clock[0] = 160.0
    assert ask() == (2, False) and ask() == (2, True)
    clock[0] = 100.0  # a clock that went back
    assert ask() == (3, False)
