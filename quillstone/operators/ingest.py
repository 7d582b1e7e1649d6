"""Markdown vaults to tables, and tables back to notes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import body_of, fallback_abstract, frontmatter_list, frontmatter_value, inline_tags, micro_abstract, path_to_doc_id, wikilinks
from quillstone.operators.hygiene import resolve_tags
from quillstone.sources.vault import chunks


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """documents, chunks, edges and nodes of files (path, content, mtime)."""
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.md$", "")
    title = F.coalesce(F.nullif(frontmatter_value("content", "title"), F.lit("")), base)
    d = files.withColumns({"id": path_to_doc_id("path"), "title": title, "body": body_of("content")})
    category = F.coalesce(F.nullif(F.lower(frontmatter_value("content", "category")), F.lit("")), F.lit("resource"))
    docs = d.select("id", "path", "title", F.col("mtime").alias("updated_at"), F.sha2("content", 256).alias("content_hash"), F.coalesce(F.nullif(micro_abstract("body"), F.lit("")), fallback_abstract("body")).alias("abstract"), category.alias("category"), "content")
    links = d.select(F.col("id").alias("src"), F.explode(wikilinks("body")).alias("l")).select("src", F.col("l.target").alias("dst"), F.col("l.relation").alias("relation"), F.lit("EXTRACTED").alias("status"), F.lit(1.0).alias("weight"))
    tag = F.array_union(inline_tags("body"), frontmatter_list("content", "tags"))
    tags = d.select(F.col("id").alias("src"), F.explode(tag).alias("tag"))
    names = docs.select("title").distinct().withColumn("pos", F.xxhash64("title"))
    found = tags.join(resolve_tags(tags, names), "tag").select("src", F.col("title").alias("dst"), F.lit("tagged_as").alias("relation"), F.lit("TAG").alias("status"), F.lit(0.3).alias("weight"))
    edges = links.union(found).dropDuplicates(["src", "dst", "relation"])
    nodes = docs.select("id", F.lit("note").alias("type"), F.col("title").alias("name")).union(edges.select(F.col("dst").alias("id"), F.lit("concept").alias("type"), F.col("dst").alias("name")).distinct().join(docs.select("id"), "id", "left_anti"))
    return {"documents": docs, "chunks": chunks(docs.select("id", "content")), "edges": edges, "nodes": nodes}


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(docs: DataFrame, edges: DataFrame, ids: DataFrame, complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents and edges without ids (id): outgoing edges go, and with complete also rows and incoming edges."""
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    if not complete:
        return docs, kept.select(*edges.columns)
    return docs.join(ids, "id", "left_anti").select(*docs.columns), kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def note_text(title: str, content, tags: list[str], aliases: list[str] | None = None):
    """Text of a note with frontmatter; tags and aliases each once."""
    items = lambda xs: F.lit("[" + ", ".join(dict.fromkeys(xs or [])) + "]")
    return F.concat(F.lit(f"---\ntitle: {title}\ntags: "), items(tags), F.lit("\naliases: "), items(aliases), F.lit(f"\n---\n\n# {title}\n\n"), content)


def append_section(text, heading: str, content: str):
    """text with content at the end of the section of that heading, which is made where it is missing."""
    level = len(heading) - len(heading.lstrip("#")) or 2
    full = heading if heading.startswith("#") else f"## {heading}"
    section = rf"(?s)((?:^|\n){re.escape(full)}[ \t]*\n.*?)(?=\n#{{1,{level}}} |\z)"
    safe = content.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(F.regexp_like(text, F.lit(section)), F.regexp_replace(text, section, "$1\n" + safe + "\n")).otherwise(F.concat(F.rtrim(text), F.lit(f"\n\n{full}\n\n{content}\n")))


def compile_note(hits: DataFrame, topic: str) -> DataFrame:
    """(text): a note with the found chunks, in order of rank, and their sources. hits (rank, title, content)."""
    part = F.struct("rank", F.concat(F.lit("## "), "title", F.lit("\n\n"), "content").alias("t"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n\n")
    return hits.agg(note_text(topic, body, ["compiled"]).alias("text"))


def reassemble(chunks_: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(document_id, content) of chunks in order."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))
    return chunks_.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), separator).alias("content"))
