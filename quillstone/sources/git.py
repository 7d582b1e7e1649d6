"""Output of `git log` and `git diff` as tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, repo: str, *args: str) -> DataFrame:
    out = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(x,) for x in out.splitlines() if x], "value string")


def parse_log(rows: DataFrame) -> DataFrame:
    """(hash, short, author, at, subject) of lines in the form %H|%h|%an|%cI|%s."""
    p = F.split("value", r"\|", 5)
    return rows.where(F.size(p) == 5).select(p[0].alias("hash"), p[1].alias("short"), p[2].alias("author"), F.to_timestamp(p[3]).alias("at"), p[4].alias("subject"))


def parse_changes(numstat: DataFrame, names: DataFrame) -> DataFrame:
    """(path, status, additions, deletions): status M where none is named; of a rename the new path; binary files count 0 lines."""
    n = F.split("value", "\t")
    target = F.regexp_replace(F.regexp_replace(n[2], r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    a = numstat.where(F.size(n) >= 3).select(target.alias("path"), F.coalesce(F.expr("try_cast(split(value, '\t')[0] as long)"), F.lit(0)).alias("additions"), F.coalesce(F.expr("try_cast(split(value, '\t')[1] as long)"), F.lit(0)).alias("deletions"))
    b = names.where(F.size(n) >= 2).select(F.element_at(n, -1).alias("path"), F.substring(n[0], 1, 1).alias("status"))
    return a.join(b, "path", "left").select("path", F.coalesce("status", F.lit("M")).alias("status"), "additions", "deletions")


def log(spark: SparkSession, repo: str, last: int = 5) -> DataFrame:
    return parse_log(lines(spark, repo, "log", f"-{last}", "--format=%H|%h|%an|%cI|%s"))


def changes(spark: SparkSession, repo: str, span: str = "HEAD~5..HEAD") -> DataFrame:
    return parse_changes(lines(spark, repo, "diff", "--numstat", span), lines(spark, repo, "diff", "--name-status", span))
