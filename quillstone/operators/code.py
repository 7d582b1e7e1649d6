"""Code index: symbols (id, file_id, kind, name, qualified_name, signature), edges (src, dst, kind), files (id, path, language)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import detect_language, extract_symbols, last_segment
from quillstone.plans.lineage import cut


def search(symbols: DataFrame, files: DataFrame, query: str, languages: list[str] | None = None, kind: str | None = None, limit: int = 10, boost: bool = True) -> DataFrame:
    """(id, qualified_name, kind, score): each token in name, qualified name or signature, in any case; an exact qualified name counts twice."""
    hit = F.lit(True)
    for t in dict.fromkeys(x for x in re.split(r"[\s,;]+", query.lower()) if x):
        one = F.lit(False)
        for c in ("name", "qualified_name", "signature"):
            one = one | F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False))
        hit = hit & one
    rows = symbols.where(hit)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if languages:
        rows = rows.join(files.where(F.col("language").isin(languages)).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    whole = bool(boost and re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)+", query.strip()))
    score = F.when(F.lit(whole) & (F.col("qualified_name") == query.strip()), 2.0).otherwise(1.0)
    return rows.select("id", "qualified_name", "kind", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def resolve_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """(id): by qualified name, else by last segment; the least id."""
    tier = F.when(F.col("qualified_name") == name, 0).when(F.col("name") == name.rsplit(".", 1)[-1], 1)
    return symbols.select("id", tier.alias("t")).where("t is not null").agg(F.min_by("id", F.struct("t", "id")).alias("id"))


def walk(edges: DataFrame, start: DataFrame, depth: int = 1, direction: str = "out") -> DataFrame:
    """(id, hop, kind): every way of at most `depth` (five) hops, with a row for each, as cycles keep theirs. start: (id)."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    wave, out = start.select(F.col("id").alias("at")), None
    if depth < 1:
        return edges.select(F.col("src").alias("id"), F.lit(0).alias("hop"), "kind").limit(0)
    for h in range(1, min(5, depth) + 1):
        wave = cut(edges.join(wave, F.col(a) == F.col("at")).select(F.col(b).alias("at"), F.lit(h).alias("hop"), "kind"))
        out = wave if out is None else out.union(wave)
        wave = wave.select("at")
    return out.select(F.col("at").alias("id"), "hop", "kind")


def walk_ways(edges: DataFrame, start: DataFrame, depth: int = 1, direction: str = "out") -> DataFrame:
    """(id, hop, kind, ways): what walk() gives, counted: a hop carries a number for each node, not a row for each way, so that hubs don't multiply."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    wave, out = start.groupBy(F.col("id").alias("at")).agg(F.count("*").alias("ways")), None
    for h in range(1, min(5, depth) + 1):
        step = cut(edges.join(wave, F.col(a) == F.col("at")).groupBy(F.col(b).alias("id"), "kind").agg(F.sum("ways").alias("ways")).select("id", F.lit(h).alias("hop"), "kind", "ways"))
        out = step if out is None else out.union(step)
        wave = step.groupBy(F.col("id").alias("at")).agg(F.sum("ways").alias("ways"))
    return edges.select(F.col("src").alias("id"), F.lit(0).alias("hop"), "kind", F.lit(0).cast("long").alias("ways")).limit(0) if out is None else out


def walk_named(steps: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Steps with the names and paths of their symbols, by hop, kind and name."""
    s = symbols.select("id", "qualified_name", "file_id")
    more = [c for c in steps.columns if c not in ("id", "hop", "kind")]
    rows = steps.join(s, "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "hop", "kind", "qualified_name", "path", *more)
    return rows.orderBy("hop", "kind", "qualified_name", "id")


def languages(files: DataFrame, limit: int = 20) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language").limit(limit)


def kinds(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("symbols"))


def orphan_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return files.join(symbols.select(F.col("file_id").alias("id")).distinct(), "id", "left_anti").select("id", "path")


def stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value)."""
    parts = [files.agg(F.count("*").alias("value")).select(F.lit("files").alias("metric"), "value"), symbols.agg(F.count("*").alias("value")).select(F.lit("symbols"), "value"), edges.agg(F.count("*").alias("value")).select(F.lit("edges"), "value"), orphan_files(files, symbols).agg(F.count("*").alias("value")).select(F.lit("orphan_files"), "value")]
    parts += [kinds(symbols).select(F.concat(F.lit("kind:"), "kind"), "symbols"), languages(files).select(F.concat(F.lit("language:"), "language"), "files")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reference_edges(symbols: DataFrame) -> DataFrame:
    """(key, others, confidence, uncertain): same-named definitions; one other makes a sure edge, more make uncertain ones."""
    s = symbols.where("kind <> 'import'").select("id", F.coalesce("name", last_segment("qualified_name")).alias("key"))
    n = s.groupBy("key").agg((F.count("*") - 1).alias("others")).where("others > 0")
    return s.join(n, "key").select("id", "key", "others", F.when(F.col("others") == 1, 1.0).otherwise(0.5).alias("confidence"), (F.col("others") > 1).alias("uncertain"))


def symbol_hash(symbols: DataFrame) -> DataFrame:
    """(file_id, ast_hash): of a file's distinct kind|name|line keys in order."""
    keys = F.array_sort(F.collect_set(F.concat_ws("|", "kind", "qualified_name", "start_line")))
    return symbols.groupBy("file_id").agg(F.sha2(F.concat(F.array_join(keys, "\n"), F.lit("\n")), 256).alias("ast_hash"))


def cache_state(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, state): first, skip_parse, skip_downstream or full; both (path, content_hash, ast_hash)."""
    s = stored.select("path", F.col("content_hash").alias("c"), F.col("ast_hash").alias("a"))
    state = F.when(F.col("c").isNull(), "first").when(F.col("c") == F.col("content_hash"), "skip_parse").when(F.col("a") == F.col("ast_hash"), "skip_downstream").otherwise("full")
    return now.join(s, "path", "left").select("path", state.alias("state"))


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and symbols of (path, content)."""
    f = files.select(F.xxhash64("path").alias("id"), "path", detect_language("path", F.substring("content", 1, 200)).alias("language"), F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), "content").where("language is not null")
    s = f.select(F.col("id").alias("file_id"), "path", F.explode(extract_symbols("content")).alias("s"))
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    s = s.select(F.xxhash64("file_id", "s.kind", "s.name", "s.line").alias("id"), "file_id", "s.kind", "s.name", F.concat(base, F.lit("."), "s.name").alias("qualified_name"), F.col("s.line").alias("start_line"))
    return f.drop("content"), s
