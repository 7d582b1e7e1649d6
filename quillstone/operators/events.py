"""Event log in batch: log (sequence, event_id, event_type, aggregate_id, revision, payload, created_at, acked_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import event_pattern

MAX_PAYLOAD = 1 << 20
#: Payload keys that are masked, and their masks (fixed values).
REDACTED = {"transcript": "[REDACTED:transcript]", "audio_url": "[REDACTED:audio_url]", "prompt": "[REDACTED:prompt]"}


def valid(log: DataFrame) -> DataFrame:
    return log.where((F.col("event_type") != "") & (F.col("aggregate_id").cast("string") != "") & (F.octet_length(F.coalesce("payload", F.lit(""))) <= MAX_PAYLOAD))


def append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The log with a batch's valid new events; an id that is there, or twice in the batch, is appended once."""
    new = valid(batch).join(log.select("event_id"), "event_id", "left_anti")
    first = new.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "event_id"]), "sequence").alias("e"))
    return log.unionByName(first.select("event_id", "e.*").select(*log.columns))


def matching(log: DataFrame, pattern: str) -> DataFrame:
    return log.where(F.col("event_type").rlike(event_pattern(pattern)))


def tail(log: DataFrame, limit: int = 20, pattern: str = "*") -> DataFrame:
    """The last events; the pattern is applied to what the limit left."""
    return matching(log.orderBy(F.desc("sequence")).limit(limit), pattern)


def since(log: DataFrame, sequence: int, limit: int) -> DataFrame:
    return log.where(F.col("sequence") >= sequence).orderBy("sequence").limit(limit)


def unacked(log: DataFrame, cursors: DataFrame, subscriber: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """Events after the subscriber's cursor (projection_name, last_sequence) that were not rejected for good."""
    own = cursors.where(F.col("projection_name") == subscriber).agg(F.coalesce(F.max("last_sequence"), F.lit(0)).alias("last"))
    rows = matching(log, pattern).join(F.broadcast(own)).where("sequence > last and (acked_at is null or not contains(acked_at, '|'))").drop("last")  # one row
    return rows.orderBy("sequence").limit(limit) if limit else rows


def acked(cursors: DataFrame, subscriber: str, sequence: int) -> DataFrame:
    """Cursors after an acknowledgement: a cursor never goes back."""
    new = cursors.sparkSession.createDataFrame([(subscriber, sequence)], "projection_name string, last_sequence long")
    return cursors.select("projection_name", "last_sequence").union(new).groupBy("projection_name").agg(F.max("last_sequence").alias("last_sequence"))


def by_type(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(limit)


def oldest_unacked(log: DataFrame, now: str) -> DataFrame:
    """(sequence, age_seconds, warn)."""
    row = log.where("acked_at is null").agg(F.min("sequence").alias("sequence"), F.min_by("created_at", "sequence").alias("at"))
    age = F.greatest(F.lit(0), F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp")))
    return row.select("sequence", age.alias("age_seconds"), (age > 300).alias("warn"))


def trace(log: DataFrame, correlation: int) -> DataFrame:
    return log.where(F.col("correlation_id") == correlation).orderBy("sequence")


def replay_counts(log: DataFrame, subscribers: DataFrame, first: int, last: int) -> DataFrame:
    """(subscriber, events): what a replay of a range would deliver; subscribers (subscriber, pattern) are a few."""
    kinds = log.where(F.col("sequence").between(first, last)).groupBy("event_type").agg(F.count("*").alias("n"))
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.col("pattern"), F.lit("."), F.lit("\\.")), F.lit("*"), F.lit("[^/]*")), F.lit("$"))
    hit = (F.col("pattern") == "*") | F.regexp_like(F.col("event_type"), pattern)
    return subscribers.join(kinds, hit, "left").groupBy("subscriber").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"))


def replayed(log: DataFrame, subscribers: DataFrame, first: int, last: int) -> DataFrame:
    """(subscriber and the log's columns): each event of a range for each subscriber (subscriber, pattern) that it matches, acknowledged or not; by subscriber and sequence. subscribers are a few, as they are kept by hand."""
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.col("pattern"), F.lit("."), F.lit("\\.")), F.lit("*"), F.lit("[^/]*")), F.lit("$"))
    kinds = log.where(F.col("sequence").between(first, last)).select("event_type").distinct()
    pairs = subscribers.join(kinds, (F.col("pattern") == "*") | F.regexp_like(F.col("event_type"), pattern)).select("subscriber", "event_type").distinct()
    rows = log.where(F.col("sequence").between(first, last)).join(pairs, "event_type")
    return rows.select("subscriber", *(F.col(c) for c in log.columns)).orderBy("subscriber", "sequence")


def redact(payload: str = "payload"):
    """struct<payload, payload_hash>: top-level keys masked, with the hash of the original; what is no object stays."""
    p = F.col(payload)
    m = F.from_json(p, "map<string,string>")
    masked = F.transform_values(m, lambda k, v: F.coalesce(*(F.when(k == x, F.lit(t)) for x, t in REDACTED.items()), v))
    hot = F.arrays_overlap(F.map_keys(m), F.array(*map(F.lit, REDACTED)))
    is_object = F.coalesce(F.ltrim(p).startswith("{"), F.lit(False)) & m.isNotNull()
    return F.struct(F.when(is_object & hot, F.to_json(masked)).otherwise(p).alias("payload"), F.sha2(p, 256).alias("payload_hash"))


def debounce(changes: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """(path, kind, n): bursts by path; the last event wins, but one that was created stays created. changes (path, ts, kind)."""
    s = changes.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("kind", "ts").alias("last"), F.max_by("kind", F.when(F.col("kind") != "MODIFY", F.col("ts"))).alias("other"))
    return s.select("path", F.when((F.col("last") == "MODIFY") & (F.col("other") == "CREATE"), "CREATE").otherwise(F.col("last")).alias("kind"), "n", F.col("w.start").alias("started"))


def latest(log: DataFrame) -> DataFrame:
    """One row for each aggregate: its highest revision, by sequence."""
    return log.groupBy("aggregate_id").agg(F.max_by(F.struct("revision", "sequence", "event_type", "payload"), F.struct("revision", "sequence")).alias("e")).select("aggregate_id", "e.*")


def project_graph(log: DataFrame) -> DataFrame:
    """(src, dst): links of committed events' anchors, each once."""
    anchors = F.from_json(F.get_json_object("payload", "$.anchors"), "array<string>")
    return log.select(F.col("aggregate_id").cast("string").alias("src"), F.explode(anchors).alias("dst")).distinct()


def health(log: DataFrame, now: str) -> DataFrame:
    return log.agg(F.count("*").alias("events"), F.max("sequence").alias("last_sequence"), F.sum(F.col("acked_at").isNull().cast("long")).alias("unacked")).join(F.broadcast(oldest_unacked(log, now)))  # one row


def with_revision(log: DataFrame) -> DataFrame:
    return log.withColumn("revision", F.row_number().over(Window.partitionBy("aggregate_id").orderBy("sequence")))


def by_json(log: DataFrame, path: str, value: str) -> DataFrame:
    """Events whose payload has the value at a JSON path; payloads that are no JSON don't match."""
    return log.where(F.get_json_object("payload", path) == value)
