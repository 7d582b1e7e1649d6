"""Logical tables: a knowledge store derived from the driver's tables, and Markdown vaults on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import chunk_text, glob_regex

#: Folders that a walk never enters (fixed values).
SKIPPED = [".git", "node_modules", "vendor", ".obsidian", ".trash", ".memory"]
CHUNK, OVERLAP = 200, 30


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, repository, path, title, updated_at, category, content_hash, content."""
    d = read(spark, sf_dir, "documents")
    category = F.element_at(F.array(F.lit("resource"), F.lit("memory"), F.lit("skill")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        "doc_id",
        F.col("source").alias("repository"),
        F.concat("lang", F.lit("/d"), "doc_id", F.lit(".md")).alias("path"),
        F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("title"),
        (F.lit(1700000000) - F.col("doc_id") * 86400).alias("updated_at"),
        category.alias("category"),
        F.sha2("text", 256).alias("content_hash"),
        "lang",
        F.col("text").alias("content"),
    )


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, document_id, chunk_index, content: word windows of each document."""
    cut = docs.select("id", F.posexplode(chunk_text("content", size, overlap)).alias("chunk_index", "content"))
    return cut.select(F.concat("id", F.lit("#"), "chunk_index").alias("id"), F.col("id").alias("document_id"), "chunk_index", "content")


def vectors(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """chunk_id, embedding: vector i belongs to chunk i div n of document i mod n."""
    n = docs.agg(F.count("*").alias("n"))
    v = read(spark, sf_dir, "embeddings").join(F.broadcast(n))  # one row
    return v.select(F.concat(F.lit("d"), F.col("vec_id") % F.col("n"), F.lit("#"), F.expr("vec_id div n")).alias("chunk_id"), "vec_id", "embedding", "label")


def document_edges(docs: DataFrame) -> DataFrame:
    """src, dst, relation, status, weight between documents, and from documents to language tags."""
    n = docs.agg(F.count("*").alias("n"))
    d = docs.select("id", "doc_id", "lang").join(F.broadcast(n))  # one row
    edge = lambda dst, relation, status, weight: F.struct(dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(status).alias("status"), F.lit(weight).alias("weight"))
    link = edge(F.concat(F.lit("d"), (7 * F.col("doc_id") + 1) % F.col("n")), "links_to", "EXTRACTED", 1.0)
    need = edge(F.concat(F.lit("d"), (13 * F.col("doc_id") + 5) % F.col("n")), "depends_on", "INFERRED", 0.6)
    tag = edge(F.concat(F.lit("#"), F.col("lang")), "tagged_as", "TAG", 0.3)
    some = F.when(F.col("doc_id") % 3 == 0, F.array(link, need, tag)).otherwise(F.array(link, tag))
    return d.select(F.col("id").alias("src"), F.explode(some).alias("e")).select("src", "e.*")


def business_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, relation, status, weight over the relational tables."""
    e = lambda t, src, dst, relation, status, weight: (read(spark, sf_dir, t) if isinstance(t, str) else t).select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(status).alias("status"), F.lit(weight).alias("weight"))
    k = lambda p, c: F.concat(F.lit(p), F.col(c))
    parts = [
        e("customer", k("c", "c_custkey"), k("n", "c_nationkey"), "part_of", "EXTRACTED", 1.0),
        e("supplier", k("s", "s_suppkey"), k("n", "s_nationkey"), "part_of", "EXTRACTED", 1.0),
        e("nation", k("n", "n_nationkey"), k("r", "n_regionkey"), "part_of", "EXTRACTED", 1.0),
        # Distinct as numbers, before they become names.
        e(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), k("p", "l_partkey"), k("s", "l_suppkey"), "depends_on", "INFERRED", 0.6),
        e("part", k("p", "p_partkey"), k("#", "p_brand"), "tagged_as", "TAG", 0.3),
        e("orders", k("o", "o_orderkey"), k("c", "o_custkey"), "links_to", "EXTRACTED", 1.0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def walk(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Markdown files below root: path (relative), content, mtime; by the scope rules."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = F.lit(root.rstrip("/") + "/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.concat(F.lit("^"), base), F.lit(""))
    rows = files.select(rel.alias("path"), F.col("content").cast("string").alias("content"), F.unix_timestamp("modificationTime").alias("mtime"))
    return rows.where(should_index(F.col("path"), include, exclude))


def should_index(path, include: list[str] | None = None, exclude: list[str] | None = None):
    """Path scope: skipped folders, then exclusions, then inclusions (none means all)."""
    ok = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED)))
    for g in exclude or []:
        ok = ok & ~path.rlike(glob_regex(g))
    if include:
        hit = F.lit(False)
        for g in include:
            hit = hit | path.rlike(glob_regex(g))
        ok = ok & hit
    return ok
