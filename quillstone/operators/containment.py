"""Exact containment of strings in strings by equi-joins on pieces of them, without pairs of all."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest gram of short strings; characters taken before and after a mark, the most first.
GRAM = 3
BEFORE, AFTER = (16, 8, 4, 2, 1, 0), (4, 2, 1, 0)


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) of the pairs of strings of parts (part) and wholes (whole) in which the part lies; both short, as titles and tags are.

    A part is filed under one of its grams, that which the fewest wholes have; wholes bring all their grams. Empty strings lie in nothing.
    """
    p, w = parts.select("part").where("part <> ''").distinct(), wholes.select("whole").where("whole <> ''").distinct()

    def grams(s: str, n) -> F.Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(F.col(s), i, n)))

    # Shorter parts have grams of their own length: at most GRAM lengths, of which only those that parts have are made.
    sizes = [r[0] for r in p.select(F.least(F.length("part"), F.lit(GRAM)).alias("n")).distinct().collect()]
    if not sizes:
        return p.join(w, F.lit(False))
    of_whole = F.flatten(F.array(*(F.when(F.length("whole") >= n, grams("whole", F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sizes)))
    filed = w.select("whole", F.explode(of_whole).alias("gram"))
    often = filed.groupBy("gram").agg(F.count("*").alias("n"))
    own = p.select("part", F.explode(grams("part", F.least(F.length("part"), F.lit(GRAM)))).alias("gram")).join(often, "gram", "left")
    # A gram that no whole has: the part lies in none.
    rare = own.groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("part", F.col("g.gram").alias("gram"))
    return rare.join(filed, "gram").where(F.contains("whole", F.col("part"))).select("part", "whole")


def _anchor(path: str, mark: str) -> tuple[int, int, str]:
    """How many characters before and after the last mark of a string are filed, and these."""
    at = path.rfind(mark)
    before, after = next(b for b in BEFORE if b <= at), next(a for a in AFTER if a <= len(path) - at - 1)
    return before, after, path[at - before : at + after + 1]


def occurrences_of(texts: DataFrame, patterns: DataFrame, least: int = 1, mark: str = ".") -> DataFrame:
    """(id, pattern, n): how often, without overlaps, the patterns (pattern, each with the mark in it) occur in texts (id, content), where that is `least` times or more.

    A pattern is filed under the characters around its last mark; so are all marks of the texts, for each of the few lengths that patterns have. What a text's marks hold is counted
    where the text lies, and only what occurs `least` times or more leaves it to meet the patterns; texts with such a hit are then counted for that pattern.
    A text travels once for each such pattern.
    """
    spark = texts.sparkSession
    # Patterns may repeat here: pairs of texts and patterns, which are far fewer, are made distinct.
    some = patterns.select("pattern").where(F.contains("pattern", F.lit(mark)))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_anchor(x, mark) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string())))], ["pattern", "before", "after", "gram"])

    filed = some.mapInArrow(file, "pattern string, before int, after int, gram string")
    kinds = [tuple(r) for r in filed.select("before", "after").distinct().collect()]  # len(BEFORE) * len(AFTER) at most

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for row, value in enumerate(b.column(1)):
                text, held = value.as_py() or "", Counter()
                at = text.find(mark)
                while at >= 0:
                    held.update((before, after, text[at - before : at + after + 1]) for before, after in kinds if before <= at and at + after < len(text))
                    at = text.find(mark, at + 1)
                often = [x for x, n in held.items() if n >= least]
                found += often
                rows += [row] * len(often)
            befores, afters, grams = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(befores, pa.int32()), pa.array(afters, pa.int32()), pa.array(grams, pa.string())], ["id", "before", "after", "gram"])

    if not kinds:
        return spark.createDataFrame([], f"id {dict(texts.dtypes)['id']}, pattern string, n long")
    given = texts.select("id", "content")
    hits = given.mapInArrow(meet, f"id {dict(texts.dtypes)['id']}, before int, after int, gram string")
    # Files that are small on disk may be large as rows: neither the patterns nor the texts are broadcast, and of the last join only the pairs are held in memory.
    near = hits.join(filed.hint("merge"), ["before", "after", "gram"]).select("id", "pattern").distinct()
    n = (F.length("content") - F.length(F.replace("content", F.col("pattern"), F.lit("")))) / F.length("pattern")
    return near.hint("shuffle_hash").join(given, "id").select("id", "pattern", n.cast("long").alias("n")).where(F.col("n") >= least)
