"""Delivery of events to subscribers, and changes between listings, as stateful streams.

A subscriber's state holds its cursor and the events that wait, with their attempts. An event that no pattern of the subscriber matches, or of a schema newer than SCHEMA, is rejected for good, without a call;
one whose handler fails waits for a jittered, doubling pause by a processing-time timer and counts as pending meanwhile; while a subscriber has `pending` such events it gets no new ones.
Subscribers don't wait for each other. `shards` parts a subscriber's events by aggregate where one task is too few.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.functions.text import event_pattern

#: Newest schema of events that is understood; pauses in milliseconds and their growth and jitter (fixed values).
SCHEMA, BASE, FACTOR, CAP, JITTER = 1, 1000, 2.0, 300_000, 0.2
DELIVERED = "subscriber string, sequence long, event_id string, outcome string, attempts int, acked_at string"
WAITING = "event_id string, event_type string, aggregate_id string, payload string, attempts int, due long"


class Rejected(Exception):
    """Raised by a handler for an event that it will never take; its text is the reason."""


@dataclass
class Subscriber:
    """handle gets an event as a dict and raises if it fails; pending: events that may wait for another try at once; timeout: seconds for a call."""

    name: str
    handle: Callable[[dict], None]
    patterns: list[str] = field(default_factory=lambda: ["*"])
    pending: int = 16
    timeout: float = 60.0


def pause(attempt: int, key: str, base: int = BASE, cap: int = CAP) -> int:
    """Milliseconds before the next try: doubling from base to cap, a fifth more or less by the event's own hash, base at least."""
    share = zlib.crc32(f"{key}:{attempt}".encode()) / 0xFFFFFFFF * 2 - 1
    return int(max(base, min(cap, base * FACTOR ** min(max(attempt, 1) - 1, 60)) * (1 + JITTER * share)))


class _Delivery(StatefulProcessor):
    def __init__(self, subscribers: list[Subscriber], base: int, cap: int):
        self.subscribers = {s.name: s for s in subscribers}
        self.base, self.cap = base, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "sequence long")
        self.queue = handle.getMapState("queue", "sequence long", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        subscriber, out = self.subscribers[key[0]], []
        last = self.cursor.get()[0] if self.cursor.exists() else -1
        patterns = [re.compile(event_pattern(p)) for p in subscriber.patterns]
        new = pd.concat(list(rows), ignore_index=True).drop_duplicates("sequence").sort_values("sequence")
        for e in new.itertuples(index=False):
            if e.sequence <= last:
                continue  # delivered before
            reason = "pattern_mismatch" if not any(p.match(e.event_type) for p in patterns) else "unsupported_schema" if e.schema_version > SCHEMA else ""
            if reason:
                out.append(self._told(subscriber, e.sequence, e.event_id, "rejected", 0, reason, timerValues))
            else:
                self.queue.updateValue((e.sequence,), (e.event_id, e.event_type, e.aggregate_id, e.payload, 0, 0))
            last = max(last, e.sequence)
        self.cursor.update((int(last),))
        yield from self._deliver(subscriber, out, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._deliver(self.subscribers[key[0]], [], timerValues)

    def _told(self, s: Subscriber, sequence: int, event_id: str, outcome: str, attempts: int, reason: str, timers) -> tuple:
        at = datetime.fromtimestamp(timers.getCurrentProcessingTimeInMs() / 1000, timezone.utc).isoformat(timespec="milliseconds")
        return s.name, int(sequence), event_id, outcome, attempts, f"{at}|{reason}" if reason else at if outcome == "acked" else None

    def _call(self, s: Subscriber, event: dict) -> None:
        # A call that doesn't come back in time has failed; its thread is left behind.
        pool = ThreadPoolExecutor(1)
        try:
            pool.submit(s.handle, event).result(s.timeout)
        finally:
            pool.shutdown(wait=False)

    def _deliver(self, s: Subscriber, out: list, timers) -> Iterator[pd.DataFrame]:
        """Tries what is due, in order, as long as no more than `pending` events wait for another try."""
        now = timers.getCurrentProcessingTimeInMs()
        waiting = sorted((k[0], v) for k, v in self.queue.iterator())
        tried = sum(v[4] > 0 for _, v in waiting)
        for sequence, (event_id, kind, aggregate, payload, attempts, due) in waiting:
            if due > now or (attempts == 0 and tried >= s.pending):
                continue
            try:
                self._call(s, {"sequence": sequence, "event_id": event_id, "event_type": kind, "aggregate_id": aggregate, "payload": payload})
                outcome, reason = "acked", ""
            except Rejected as e:
                outcome, reason = "rejected", str(e) or "rejected"
            except BaseException as e:  # whatever a handler does, the stream goes on
                outcome, reason = "failed", type(e).__name__
            attempts += 1
            if outcome == "failed":
                tried += attempts == 1
                due = now + pause(attempts, event_id, self.base, self.cap)
                self.queue.updateValue((sequence,), (event_id, kind, aggregate, payload, attempts, due))
                self.handle.registerTimer(due)
                out.append((s.name, sequence, event_id, outcome, attempts, None))
            else:
                tried -= attempts > 1
                self.queue.removeKey((sequence,))
                out.append(self._told(s, sequence, event_id, outcome, attempts, reason, timers))
        if any(v[4] == 0 for _, v in self.queue.iterator()):
            self.handle.registerTimer(now + self.base)  # events that had no room
        if out:
            yield pd.DataFrame(out, columns=["subscriber", "sequence", "event_id", "outcome", "attempts", "acked_at"])

    def close(self) -> None:
        pass


def delivered(events: DataFrame, subscribers: list[Subscriber], shards: int = 1, base: int = BASE, cap: int = CAP) -> DataFrame:
    """What becomes of each event of a stream (sequence, event_id, event_type, aggregate_id, payload, schema_version) for each subscriber: a row for each try, with the outcome acked, failed or rejected; acked_at: the time, of a reject `time|reason`.

    Sequences rise from batch to batch: what comes again below the cursor is delivered already. Needs the RocksDB state store; the session's `use_rocksdb` sets it.
    """
    names = F.explode(F.array(*(F.lit(s.name) for s in subscribers)))
    part = F.pmod(F.crc32(F.coalesce(F.col("aggregate_id").cast("string"), F.lit("")).cast("binary")), F.lit(shards))
    text = [F.col(c).cast("string").alias(c) for c in ("event_id", "event_type", "aggregate_id", "payload")]
    rows = events.select(names.alias("subscriber"), part.alias("shard"), F.col("sequence").cast("long").alias("sequence"), *text, F.coalesce(F.col("schema_version").cast("int"), F.lit(1)).alias("schema_version"))
    return rows.groupBy("subscriber", "shard").transformWithStateInPandas(_Delivery(subscribers, base, cap), DELIVERED, "append", "processingTime")


def cursors(found: DataFrame) -> DataFrame:
    """(projection_name, last_sequence): how far each subscriber has taken or refused all events, of rows of `delivered`."""
    done = found.where("outcome <> 'failed'")
    return done.groupBy(F.col("subscriber").alias("projection_name")).agg(F.max("sequence").alias("last_sequence"))


def use_rocksdb(spark) -> None:
    """State of these streams needs RocksDB, which comes with Spark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ------------------------------------------------------------------ listings


class _Snapshots(StatefulProcessor):
    """The last listing of a part of the paths."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scans = handle.getValueState("scan", "scan long")
        self.files = handle.getMapState("files", "path string", "mtime long, size long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given, out = pd.concat(list(rows), ignore_index=True), []
        last = self.scans.get()[0] if self.scans.exists() else None
        for scan, listing in given.groupby("scan"):  # in order
            if last is not None and scan <= last:
                continue
            now = {r.path: (int(r.mtime), int(r.size)) for r in listing.dropna(subset=["path"]).itertuples(index=False)}
            before = {k[0]: tuple(v) for k, v in self.files.iterator()}
            for path in sorted(now.keys() | before.keys()):
                if path not in now:
                    self.files.removeKey((path,))
                    event = "DELETE"
                elif now[path] == before.get(path):
                    continue
                else:
                    self.files.updateValue((path,), now[path])
                    event = "MODIFY" if path in before else "CREATE"
                if last is not None:  # the first listing is what there is
                    out.append((int(scan), path, event, *now.get(path, (None, None))))
            last = int(scan)
        self.scans.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["scan", "path", "event", "mtime", "size"]).astype({"mtime": "Int64", "size": "Int64"})

    def close(self) -> None:
        pass


def listing(files: DataFrame, scan: int, shards: int = 8) -> DataFrame:
    """A listing (path, mtime, size) as rows for `changed`: each part of the paths has a row without a path too, so that a part that is empty is heard of."""
    rows = files.select(F.lit(scan).cast("long").alias("scan"), F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(shards)).cast("int").alias("shard"), "path", F.col("mtime").cast("long").alias("mtime"), F.col("size").cast("long").alias("size"))
    marks = files.sparkSession.range(shards).select(F.lit(scan).cast("long"), F.col("id").cast("int"), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    return rows.union(marks)


def changed(listings: DataFrame) -> DataFrame:
    """(scan, path, event, mtime, size) between successive listings of a stream of rows of `listing`: CREATE, MODIFY (another time or size) and DELETE. The first listing makes no events."""
    return listings.groupBy("shard").transformWithStateInPandas(_Snapshots(), "scan long, path string, event string, mtime long, size long", "append", "none")
