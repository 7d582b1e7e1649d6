"""Operator 9: mixing sources to target weights by capped water-filling.

Sources are aggregated to their sizes. The level (words for each unit of weight) starts at total / weights; sources whose
share passes `epochs` times their size are clamped there, and the rest of the total goes to the others by weight,
which raises the level, until none is above. Each round is one small aggregation, of which the driver gets two numbers.

A document is then taken floor(target / source size) times whole. The fraction is dealt by a seeded hash of the doc_id and text: a histogram of
each source's words over BINS ranges of the hash gives the range in which the wanted words are
reached; all documents below it are taken, and those in it, in order of the hash, up to the nearest sum. So
each source meets its target up to half a document, no sort ever holds more than a range of a source,
and a rerun takes the same documents.

Defined results. Null text or one without words: size 0, taken 0. Null source: a source of its own, last. A source without words:
target 0. Null doc_id: hashed as 'null', and told apart by the text. Ties of the hash are ordered by a hash of the row, so only rows that are equal
throughout are taken in any order, which doesn't show. Extra columns are passed through. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import SPACE, cut

BINS = 4096
WEIGHTS = (5, 2, 1)


def n_words(col: str = "text"):
    """Number of words `[^\\x20\\x09-\\x0D]+`."""
    flat = F.translate(F.coalesce(F.col(col), F.lit("")), SPACE, " " * len(SPACE))
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


def seeded(seed: int):
    """A number in [0, 2^32) from the seed, doc_id and text, the same in any engine that has MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Weights go to sources by code point, null last, and repeat."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    options = F.array(*(F.lit(float(w)) for w in weights))
    rows = cut(sizes.withColumn("weight", F.element_at(options, (place % len(weights) + 1).cast("int"))))
    total, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / (weight or 1)
    while True:
        above = F.col("weight") * F.lit(level) > epochs * F.col("source_size")
        left, free = rows.agg(F.lit(total or 0) - F.coalesce(F.sum(F.when(above, epochs * F.col("source_size"))), F.lit(0)), F.sum(F.when(~above, F.col("weight")))).first()
        raised = left / free if free else level
        if raised <= level:
            break
        level = raised
    return rows.select("source", "source_size", F.least(F.col("weight") * F.lit(level), (epochs * F.col("source_size")).cast("double")).alias("target"))


def _planned(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = 42) -> DataFrame:
    """doc (the columns to keep), size, source_size, target and times of every row of docs."""
    kinds = dict(docs.dtypes)
    facts = [x for c in [*keep, "text"] if "map<" not in kinds[c] for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), F.col("source").cast("string").alias("source"), n_words().alias("size"), seeded(seed).alias("u"), F.xxhash64(*facts).alias("tie"))
    base = rows.withColumn("bin", F.floor(F.col("u") * BINS / (1 << 32)))
    # (source, bin): what the targets and the histogram need, from one aggregation.
    bins = cut(base.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    per_source = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = per_source.withColumn("whole", whole).withColumn("want", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    ranges = bins.withColumn("before", F.coalesce(before, F.lit(0)))
    info = ranges.join(plan, ranges["source"].eqNullSafe(plan["source"]))
    # The range where the wanted words are reached: documents there need their order.
    until = F.col("before") + F.col("words")
    split = (F.col("before") < F.col("want")) & (until > F.col("want"))
    info = cut(info.select(ranges["source"].alias("s"), F.col("bin").alias("b"), "source_size", "target", "whole", "want", "before", split.alias("split"), (until <= F.col("want")).alias("all_in")))
    joined = base.join(info, base["source"].eqNullSafe(info["s"]) & (base["bin"] == info["b"]))
    # Other ranges are spread over partitions by their hash, so that the window deals out no source.
    salt = F.when(F.col("split"), F.lit(-1)).otherwise(F.col("u"))
    upto = F.sum(F.when(F.col("split"), F.col("size")).otherwise(0)).over(Window.partitionBy("source", "bin", salt).orderBy("u", "tie").rowsBetween(Window.unboundedPreceding, 0))
    nearest = F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("want")
    extra = F.when(F.col("split"), nearest.cast("long")).otherwise(F.col("all_in").cast("long"))
    return joined.withColumn("upto", upto).select("doc", *OWN[:3], (F.col("whole") + extra).alias("times"))


OWN = ("size", "source_size", "target", "times")


def mix(docs: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """docs (all columns, or those to keep) with size, source_size, target (of its source) and times (how often the mix takes it), in place of columns so named."""
    keep = keep or docs.columns
    return _planned(docs, keep, **options).select(*(F.col(f"doc.`{c}`") for c in keep if c not in OWN), *OWN)


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    taken = _planned(docs, docs.columns, **options).where("times > 0")
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("doc.*")
