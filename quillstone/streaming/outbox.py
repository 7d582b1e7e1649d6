"""Transactional outbox: the effects of a batch and the events that tell of them become visible together.

A transaction is a number. Its tables are written in folders of their own, and one file in `commits`, written last, makes all of them visible: a failure between the writes shows neither effects
nor events, and the transaction's next try replaces what the failed one left. A number that is committed is done: a retry changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.events import MAX_PAYLOAD
from quillstone.plans.commits import Folder
from quillstone.plans.lineage import cut

EVENTS = "events"


class InvalidEvent(ValueError):
    """The first invalid event of a batch; nothing of the batch is kept."""


def first_invalid(events: DataFrame) -> DataFrame:
    """(sequence, event_type, reason) of the first event, by sequence, that the log does not take."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    reason = F.when(text("event_id") == "", "event_id is missing").when(text("event_type") == "", "event_type is missing").when(text("aggregate_id") == "", "aggregate_id is missing").when(F.octet_length(text("payload")) > MAX_PAYLOAD, "payload is too large")
    return events.select("sequence", "event_type", reason.alias("reason")).where("reason is not null").orderBy("sequence").limit(1)


class Outbox:
    """Tables of effects and the log of events in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Folder(spark, folder)

    def committed(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("commits") if re.fullmatch(r"\d+\.json", n))

    def read(self, table: str) -> DataFrame | None:
        """The rows of a table in all committed transactions, None where there are none yet."""
        paths = [f"{self.files.path}/{table}/transaction={n}" for n in self.committed() if self.files.exists(f"{table}/transaction={n}")]
        return self.spark.read.option("basePath", f"{self.files.path}/{table}").parquet(*paths) if paths else None

    def emit(self, number: int, effects: dict[str, DataFrame], events: DataFrame) -> bool:
        """Commits effects and events (sequence, event_id, event_type, aggregate_id, payload) as one; False if the number is committed already.

        The first invalid event stops all. An event whose id the log holds, or that stands twice, is added once, and effects that carry the id of an event that the log holds are not applied again.
        """
        if EVENTS in effects:
            raise ValueError("the table of events is the outbox's own")
        if number in self.committed():
            return False
        events = cut(events)
        bad = first_invalid(events).first()
        if bad:
            raise InvalidEvent(f"batch {number}, event {bad['sequence']} of type {bad['event_type']!r}: {bad['reason']}")
        known = self.read(EVENTS)
        new = events if known is None else events.join(known.select("event_id"), "event_id", "left_anti")
        rest = [c for c in events.columns if c != "event_id"]
        once = new.groupBy("event_id").agg(F.min_by(F.struct(*rest), "sequence").alias("e")).select("event_id", "e.*").select(*events.columns)
        for table, rows in effects.items():
            if known is not None and "event_id" in rows.columns:
                rows = rows.join(known.select("event_id"), "event_id", "left_anti").select(*rows.columns)
            rows.write.mode("overwrite").parquet(f"{self.files.path}/{table}/transaction={number}")
        once.write.mode("overwrite").parquet(f"{self.files.path}/{EVENTS}/transaction={number}")
        return self.files.write(f"commits/{number}.json", {"tables": sorted([*effects, EVENTS])})


def transactional(stream: DataFrame, outbox: Outbox, work: Callable[[DataFrame], tuple[dict[str, DataFrame], DataFrame]], checkpoint: str):
    """A query whose batches go through the outbox: work gives a batch's effects and events. A batch that runs again after a failure is committed once."""

    def run(batch: DataFrame, epoch: int) -> None:
        if epoch not in outbox.committed():
            outbox.emit(epoch, *work(cut(batch)))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)
