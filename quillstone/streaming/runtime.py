"""Streaming forms of the event log: one query for each subscriber, the checkpoint is its cursor."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.lexical_index import LexicalIndex
from quillstone.plans.lineage import cut
from quillstone.operators.events import latest, matching, project_graph, redact, valid


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Event files as they come; the files for each trigger bound what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Valid events, each id once within the delay."""
    return valid(events).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def deliver(events: DataFrame, pattern: str, handle: Callable[[DataFrame, int], None], checkpoint: str, attempts: int = 3, pause: float = 0.1):
    """A subscriber: in-order batches that succeed as a unit; a failing one is tried again with doubling pauses, then stops the query."""

    def run(batch: DataFrame, epoch: int) -> None:
        for n in range(1, attempts + 1):
            try:
                return handle(batch, epoch)
            except Exception:
                if n == attempts:
                    raise
                time.sleep(min(30.0, pause * 2 ** (n - 1)))

    return matching(events, pattern).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def document_projection(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch's latest rows in a folder of its own: a batch that runs again replaces its own, and readers take the highest revision."""

    def handle(batch: DataFrame, epoch: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return handle


def search_projection(index: LexicalIndex, files: Callable[[DataFrame], DataFrame], first: int = 1) -> Callable[[DataFrame, int], None]:
    """Committed notes in a LexicalIndex: each batch's latest revisions are an epoch, with the note's text from its file; a `memory.deleted` event is a tombstone.

    files: the files (path, content) of rows (path). A file that is not there yet is an error, so that the batch is tried again.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        kept = batch.where(F.col("event_type").isin("memory.committed", "memory.deleted"))
        new = latest(kept).select(F.col("aggregate_id").cast("string").alias("id"), "revision", (F.col("event_type") == "memory.deleted").alias("deleted"), F.get_json_object("payload", "$.path").alias("path"))
        rows = cut(new.join(files(new.where("not deleted").select("path").distinct()), "path", "left").select("id", "revision", "deleted", "path", "content"))
        gone = rows.where("not deleted and content is null").select("path").first()
        if gone:
            raise FileNotFoundError(gone["path"])
        index.apply(first + epoch, rows)

    return handle


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.parquet(path)).drop("epoch")


def graph_projection(path: str) -> Callable[[DataFrame, int], None]:
    def handle(batch: DataFrame, epoch: int) -> None:
        project_graph(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return handle


def audit(path: str) -> Callable[[DataFrame, int], None]:
    """Redacted events as JSON lines, a folder for each batch."""

    def handle(batch: DataFrame, epoch: int) -> None:
        r = redact()
        batch.select("sequence", "event_id", "event_type", "aggregate_id", r["payload"].alias("payload"), r["payload_hash"].alias("payload_hash")).write.mode("overwrite").json(f"{path}/epoch={epoch}")

    return handle


def reindexed(changes: DataFrame, index: LexicalIndex, checkpoint: str, first: int = 1):
    """A stream of changed documents kept up in a LexicalIndex: its batches are the index's epochs from `first` on. A batch that runs again changes nothing."""
    return changes.writeStream.foreachBatch(lambda batch, epoch: index.apply(first + epoch, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def debounced(changes: DataFrame, gap: str = "500 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Bursts of changes (path, ts, kind) as they close."""
    s = changes.withWatermark("ts", delay).groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("kind", "ts").alias("last"), F.max_by("kind", F.when(F.col("kind") != "MODIFY", F.col("ts"))).alias("other"))
    return s.select("path", F.when((F.col("last") == "MODIFY") & (F.col("other") == "CREATE"), "CREATE").otherwise(F.col("last")).alias("kind"), "n")
