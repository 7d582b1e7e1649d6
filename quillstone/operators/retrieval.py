"""Lexical, vector and graph retrieval, and their fusion by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scoring import cosine, l2, time_decay
from quillstone.functions.stemming import stem, stems_of
from quillstone.functions.text import fallback_abstract, jaccard, lexical_tokens, query_phrases
from quillstone.operators.lexical_index import LexicalIndex, document_of, scored
from quillstone.plans.lineage import cut

#: Sources of a search in their order.
SOURCES = ("fts", "vector", "graph")
#: Rows of a block of vectors whose pairs one task scores, rows of it that are scored at once, and pairs.
PAIRED, STRIP, DOTS = 4096, 256, 1 << 16


def bm25(chunks: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(chunk_id, score) of chunks that hold all phrases of the query, best first, without an index.

    Only counts of the query's phrases leave a chunk: one scan, whose rows of numbers are written and read for statistics and hits.
    """
    phrases = [stems_of(p) for p in query_phrases(query)]

    def count(t: Column, phrase: list[str]) -> Column:
        first, *more = phrase
        if not more:
            return F.size(F.filter(t, lambda w: w == F.lit(first)))
        whole = F.array(*map(F.lit, phrase))
        places = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))
        return F.size(F.filter(places, lambda i: F.slice(t, i, len(phrase)) == whole))

    def numbers(t: Column) -> Column:
        return F.struct(F.size(t).alias("len"), *(count(t, p).alias(f"tf{i}") for i, p in enumerate(phrases)))

    # The tokens are the variable of a lambda: they are made once for a chunk.
    made = F.transform(F.array(stem(lexical_tokens("content"))), numbers)
    rows = cut(chunks.select(F.col("id").alias("chunk_id"), F.explode(made).alias("x")).select("chunk_id", "x.*"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(phrases))))
    hit = F.lit(bool(phrases))
    for i in range(len(phrases)):
        hit = hit & (F.col(f"tf{i}") > 0)
    return scored(rows.where(hit), stats, len(phrases), limit)


def knn(vectors: DataFrame, query: list[float], limit: int, metric: str = "cosine") -> DataFrame:
    """(chunk_id, distance) of the nearest vectors; ties by id. Top-k is kept in each partition before it is merged."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = 1 - cosine("embedding", q) if metric == "cosine" else l2("embedding", q)
    return vectors.select("chunk_id", d.alias("distance")).orderBy("distance", "chunk_id").limit(limit)


def rotation(dim: int, seed: int = 421337, reflections: int = 32) -> np.ndarray:
    """A product of seeded Householder reflections: orthogonal, so norms and dot products stay."""
    rng, r = np.random.default_rng(seed), np.eye(dim)
    for _ in range(reflections):
        v = rng.standard_normal(dim)
        v /= np.linalg.norm(v)
        r = r - 2 * np.outer(v, v @ r)
    return r


def quantize(vectors: DataFrame, dim: int, rotate: bool = True) -> DataFrame:
    """(chunk_id, scale, data): four bits for each coordinate of the rotated vector, low half first."""
    r = rotation(dim) if rotate else np.eye(dim)

    def run(it):
        for p in it:
            x = np.stack(p["embedding"].to_list()).astype(np.float64) @ r.T if len(p) else np.zeros((0, dim))
            scale = np.abs(x).max(axis=1) if len(p) else np.zeros(0)
            scale[scale == 0] = 1e-6
            y = x / scale[:, None] * 7
            code = (np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -7, 7) + 7).astype(np.uint8)
            data = code[:, 0::2] | code[:, 1::2] << 4
            yield pd.DataFrame({"chunk_id": p["chunk_id"], "scale": scale.astype(np.float32), "data": [d.tobytes() for d in data]})

    return vectors.where(F.size("embedding") == dim).select("chunk_id", "embedding").mapInPandas(run, "chunk_id string, scale float, data binary")


def _unpacked(data: pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    out = np.empty((len(data), raw.shape[1] * 2))
    out[:, 0::2], out[:, 1::2] = raw & 15, raw >> 4
    return out - 7


def quantized_knn(codes: DataFrame, query: list[float], limit: int, rotate: bool = True) -> DataFrame:
    """(chunk_id, distance = 1 - dot) by the codes."""
    dim = len(query)
    q = (rotation(dim) if rotate else np.eye(dim)) @ np.asarray(query, float)

    def dot(scale: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series(1 - scale.to_numpy(float) / 7 * (_unpacked(data) @ q)) if len(data) else pd.Series(dtype=float)

    return codes.select("chunk_id", F.pandas_udf(dot, "double")("scale", "data").alias("distance")).orderBy("distance", "chunk_id").limit(limit)


def dequantize(codes: DataFrame, dim: int, rotate: bool = True) -> DataFrame:
    r = rotation(dim) if rotate else np.eye(dim)

    def back(scale: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series(list((_unpacked(data) * (scale.to_numpy(float) / 7)[:, None] @ r).astype(np.float32))) if len(data) else pd.Series(dtype=object)

    return codes.select("chunk_id", F.pandas_udf(back, "array<float>")("scale", "data").alias("embedding"))


def ranked(hits: DataFrame, source: str, order: list) -> DataFrame:
    """(source, rank, item) of a limited list of hits."""
    return hits.select(F.lit(source).alias("source"), F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col("chunk_id").alias("item"))


def rrf(lists: DataFrame, k: int = 60, order: tuple[str, ...] = SOURCES) -> DataFrame:
    """(item, score, n_sources, sources) of ranked lists (source, rank, item), best first; each source counts once for an item. order: that of the sources in `sources`, others follow by name."""
    k = k if k > 0 else 60
    best = lists.groupBy("item", "source").agg(F.min("rank").alias("rank"))
    turn = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    entry = F.struct(F.when(turn > 0, turn).otherwise(len(order) + 1).alias("turn"), "source", F.concat("source", F.lit(":"), "rank").alias("text"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ",")
    out = best.groupBy("item").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.count("*").alias("n_sources"), names.alias("sources"))
    return out.orderBy(F.desc("score"), F.desc("n_sources"), "item")


def with_document(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """hits (chunk_id, ...) with document_id, category, updated_at and abstract; category falls back to resource."""
    d = docs.select(F.col("id").alias("document_id"), "title", "updated_at", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("resource")).alias("category"))
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "content")
    return hits.join(c, "chunk_id").join(d, "document_id", "left")


def seeds(lex: DataFrame, vec: DataFrame, chunks: DataFrame, from_lex: int = 3, total: int = 6) -> DataFrame:
    """(document_id, seed): distinct documents by first appearance, of the lexical list first, filled up from the vector list."""
    both = lex.select("rank", "item", F.lit(0).alias("s")).union(vec.select("rank", "item", F.lit(1).alias("s")))
    first = both.join(chunks.select(F.col("id").alias("item"), "document_id"), "item").groupBy("document_id").agg(F.min(F.when(F.col("s") == 0, F.col("rank"))).alias("a"), F.min(F.when(F.col("s") == 1, F.col("rank"))).alias("b"))
    la = F.row_number().over(Window.orderBy(F.col("a").isNull(), "a", "document_id"))
    first = first.withColumn("p", F.when(F.col("a").isNotNull() & (la <= from_lex), la))
    order = Window.orderBy(F.col("p").isNull(), "p", F.col("b").isNull(), "b", "document_id")
    return first.where("p is not null or b is not null").withColumn("seed", F.row_number().over(order)).where(f"seed <= {total}").select("document_id", "seed")


def graph_expansion(start: DataFrame, edges: DataFrame, chunks: DataFrame, per_document: int = 2) -> DataFrame:
    """(source, rank, item): the first chunks of documents one hop out of the seeds, by seed, neighbour and chunk."""
    near = edges.select("src", F.col("dst").alias("n")).join(F.broadcast(start), F.col("src") == F.col("document_id")).groupBy("n").agg(F.min("seed").alias("seed"))  # at most six seeds
    hit = chunks.where(F.col("chunk_index") < per_document).join(near, F.col("document_id") == F.col("n"))
    return hit.select(F.lit("graph").alias("source"), F.row_number().over(Window.orderBy("seed", "document_id", "chunk_index")).alias("rank"), F.col("id").alias("item"))


def neighbors_of(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits (document_id, ...) with neighbors: what their documents are linked to and from, each once and in order. Hits are a short list; edges are cut to it before they meet."""
    own = hits.select("document_id").distinct()
    ends = F.explode(F.array(F.struct(F.col("src").alias("document_id"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("document_id"), F.col("src").alias("n"))))
    near = edges.where("src <> dst").select(ends.alias("e")).select("e.*").join(F.broadcast(own), "document_id").groupBy("document_id").agg(F.array_sort(F.collect_set("n")).alias("neighbors"))
    return hits.join(near, "document_id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<string>")))


def hybrid(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, edges: DataFrame, query: str, vector: list[float], limit: int = 5, k: int = 60, category: str = "", decay: dict | None = None, level: str = "l1", repository: str = "", mode: str = "hybrid", index: LexicalIndex | None = None, codes: DataFrame | None = None, neighbors: bool = False) -> DataFrame:
    """Lexical, vector and graph candidates in one plan: rank, chunk_id, document_id, score, n_sources, sources, category, title, content; neighbors: with the documents next to each hit.

    repository: '' for all; it limits what is searched. category: hits of others keep their places in the lists and are left out of the fusion. mode: hybrid, fts or vector.
    index: of the documents, which then gives chunks and documents by their ids; else docs and chunks are scanned. codes: four-bit codes that answer if the vectors give nothing.
    """
    many = max(10, 2 * limit)
    within = None
    if index:
        found_chunks, found_docs = index.chunks, index.facts
    else:
        found_chunks = lambda ids, first=None: (chunks if first is None else chunks.where(F.col("chunk_index") < first)).join(ids.select("document_id").distinct(), "document_id", "left_semi")
        found_docs = lambda ids: docs.withColumnRenamed("id", "document_id").join(ids.select("document_id").distinct(), "document_id", "left_semi")
    if repository:
        own = (index.documents() if index else docs.withColumnRenamed("id", "document_id")).where(F.col("repository") == repository)
        within = own.select("document_id")
        vectors = vectors.withColumn("document_id", document_of("chunk_id")).join(within, "document_id", "left_semi")
    found = []
    if mode in ("hybrid", "fts"):
        if index:
            hits = index.bm25(query, many, within)
        else:
            hits = bm25(chunks if within is None else chunks.join(within, "document_id", "left_semi"), query, many)
        found.append(short(ranked(hits, "fts", [F.desc("score"), "chunk_id"])))
    if mode in ("hybrid", "vector"):
        found.append(short(ranked(knn_or_codes(vectors, codes, vector, many), "vector", ["distance", "chunk_id"])))
    lists = found[0]
    for more in found[1:]:
        lists = lists.union(more)
    full = short(_held(found_chunks, lists))  # at most `many` of each list
    if mode == "hybrid":
        start = short(seeds(*found, full))
        near = edges.join(F.broadcast(start), F.col("src") == F.col("document_id")).groupBy(F.col("dst").alias("document_id")).agg(F.min("seed").alias("seed"))  # at most six seeds
        if within is not None:
            near = near.join(within, "document_id", "left_semi")
        near = cut(near)
        more = cut(found_chunks(near, 2).join(near, "document_id"))
        place = F.row_number().over(Window.orderBy("seed", "document_id", "chunk_index"))
        lists = lists.union(more.select(F.lit("graph").alias("source"), place.alias("rank"), F.col("id").alias("item")))
        full = full.union(more.select(full.columns)).dropDuplicates(["id"])
    facts = found_docs(full.select("document_id")).select("document_id", "title", "updated_at", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("resource")).alias("category"))
    if category:
        own = full.join(facts.where(F.lower("category") == category.lower()), "document_id", "left_semi").select(F.col("id").alias("item"))
        lists = lists.join(own, "item", "left_semi").select("source", "rank", "item")
    full = rrf(lists, k).withColumnRenamed("item", "chunk_id").join(full.withColumnRenamed("id", "chunk_id"), "chunk_id").join(facts, "document_id", "left")
    if decay:
        full = full.withColumn("score", F.col("score") * time_decay("updated_at", **decay))
    order = [F.desc(F.round("score", 12)), F.desc("n_sources"), "chunk_id", "document_id"]
    if level == "l0":
        full = full.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc(F.round("score", 12)), "chunk_id"))).where("n = 1").withColumn("abstract", fallback_abstract("content")).withColumn("content", F.lit(""))
    cols = ["chunk_id", "document_id", "score", "n_sources", "sources", "category", "title", "abstract" if level == "l0" else "content"]
    top = full.orderBy(*order).limit(limit)
    top = top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), *cols)
    return neighbors_of(short(top), edges).select("rank", *cols, "neighbors") if neighbors else top


def short(rows: DataFrame) -> DataFrame:
    """A list that a limit bounds, made now: later plans hold its rows instead of computing it again."""
    return rows.sparkSession.createDataFrame(rows.toArrow()).coalesce(1)


def _held(find: Callable[..., DataFrame], lists: DataFrame) -> DataFrame:
    """The chunks of short lists (item) that are there."""
    items = lists.select(F.col("item").alias("id"), document_of("item").alias("document_id"))
    return find(items).join(items.select("id").distinct(), "id", "left_semi").select("id", "document_id", "chunk_index", "content")


def knn_or_codes(vectors: DataFrame, codes: DataFrame | None, query: list[float], limit: int, metric: str = "cosine") -> DataFrame:
    """knn; where that gives nothing, or fails, the four-bit codes answer."""
    if codes is None:
        return knn(vectors, query, limit, metric)
    try:
        near = cut(knn(vectors, query, limit, metric))
        if near.limit(1).count():
            return near
    except PySparkException:
        pass
    return quantized_knn(codes, query, limit)


def with_vectors(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """chunks with their embedding, zeros where there is none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return chunks.join(vectors.select(F.col("chunk_id").alias("id"), "embedding"), "id", "left").withColumn("embedding", F.coalesce("embedding", zero))


def to_blob(v: str = "embedding") -> Column:
    """A vector as little-endian 32-bit floats; null stays null."""
    pack = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes()), "binary")
    return pack(F.col(v))


def from_blob(b: str = "data") -> Column:
    """The floats of a blob; one whose length is no multiple of four gives null."""
    unpack = F.pandas_udf(lambda s: s.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist()), "array<float>")
    return unpack(F.col(b))


def merge_first(rows: DataFrame) -> DataFrame:
    """One row for each chunk_id of rows (chunk_id, position, content, abstract, category, updated_at, neighbors array): first non-empty texts, the newest time, the first category
    other than resource, and all neighbours in order, each once."""
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("position")))
    some = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    kind = F.coalesce(first("category", some("category") & (F.lower("category") != "resource")), first("category", some("category")), F.lit("resource"))
    near = F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("neighbors", F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])
    return rows.groupBy("chunk_id").agg(F.coalesce(first("content", some("content")), F.lit("")).alias("content"), F.coalesce(first("abstract", some("abstract")), F.lit("")).alias("abstract"), kind.alias("category"), F.max("updated_at").alias("updated_at"), F.array_distinct(F.flatten(near)).alias("neighbors"))


def federate(local: DataFrame, central: DataFrame, limit: int = 5, k: int = 60) -> DataFrame:
    """(item, score, origin, sources) of two ranked lists (rank, item)."""
    both = local.select(F.lit("local").alias("source"), "rank", "item").union(central.select(F.lit("central").alias("source"), "rank", "item"))
    out = rrf(both, k, ("local", "central"))
    origin = F.when(F.col("n_sources") > 1, "[local+central]").when(F.col("sources").startswith("local"), "[local]").otherwise("[central]")
    return out.withColumn("origin", origin).orderBy(F.desc(F.round("score", 12)), "item").limit(limit)


def federated_search(local: Callable[[], DataFrame], central: Callable[[], DataFrame] | None, limit: int = 5, k: int = 60) -> tuple[DataFrame, str]:
    """The merged lists and a note. No central store, or one that fails: the local list alone; a local one that fails: the central list alone; both: the local error is raised."""

    def run(search: Callable[[], DataFrame]) -> tuple[DataFrame | None, Exception | None]:
        try:
            return cut(search().select("rank", "item")), None
        except (PySparkException, OSError) as e:
            return None, e

    own, error = run(local)
    far, missing = run(central) if central else (None, None)
    if own is None and far is None:
        raise error
    note = "" if own is not None and (far is not None or central is None) else "central unavailable" if own is not None else "local unavailable"
    empty = (own if own is not None else far).limit(0)
    return federate(own if own is not None else empty, far if far is not None else empty, limit, k), note


def latent_pairs(docs: DataFrame, sets: DataFrame, edges: DataFrame, score, least: float, limit: int) -> DataFrame:
    """(a, b, similarity) of unlinked documents of one repository; sets: (id, repository, item), score(x, y) of two items."""
    a = sets.select("repository", F.col("id").alias("a"), F.col("item").alias("x"))
    b = sets.select("repository", F.col("id").alias("b"), F.col("item").alias("y"))
    best = a.join(b, "repository").where("a < b").groupBy("a", "b").agg(F.max(score("x", "y")).alias("similarity")).where(F.col("similarity") >= least)
    linked = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return best.join(linked, ["a", "b"], "left_anti").orderBy(F.desc(F.round("similarity", 9)), "a", "b").limit(limit)


def latent_vectors(docs: DataFrame, sets: DataFrame, edges: DataFrame, least: float, limit: int) -> DataFrame:
    """What latent_pairs gives for vectors (id, repository, item) by cosine.

    All pairs of a repository are scored, in blocks of PAIRED rows: matrix products find those that may be among a block's first, which alone are scored by the steps of `cosine`. A pair
    that is among the first of all is among the first of its block, so a block gives that many at most; where links take too many of these, more are asked for.
    """
    some = sets.where("id is not null and repository is not null and size(item) > 0").select("id", "repository", F.col("item").cast("array<double>").alias("item"))
    odd = F.exists("item", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 1e100))
    some = cut(some.withColumn("odd", odd))
    if least <= 0 or not some.where("odd").isEmpty():
        return latent_pairs(docs, sets, edges, cosine, least, limit)
    rows = some.select("id", "repository", "item", F.size("item").alias("dim"))
    sizes = rows.groupBy("repository", "dim").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("n"))
    dealt = rows.join(F.broadcast(sizes), ["repository", "dim"]).withColumn("block", F.pmod(F.xxhash64("id", "item"), F.col("n")).cast("int"))  # a row for each repository and length
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    linked = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    order, many = [F.desc(F.round("similarity", 9)), "a", "b"], 2 * limit
    while True:
        each = dealt.groupBy("repository", "dim", "x", "y").applyInArrow(_first_pairs(least, many), "a string, b string, similarity double")
        best = short(each.groupBy("a", "b").agg(F.max("similarity").alias("similarity")).orderBy(*order).limit(many))
        met = linked.join(F.broadcast(best.select("a", "b")), ["a", "b"], "left_semi").distinct()  # `many` pairs
        out = short(best.join(met, ["a", "b"], "left_anti").orderBy(*order).limit(limit))
        if out.count() == limit or best.count() < many:
            return out.orderBy(*order)
        many *= 4


def _first_pairs(least: float, many: int):
    """The first pairs of different ids of two blocks of rows (id, item, block, x, y), or of one, by the score to nine digits and the ids."""

    def dots(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros(len(p))
        for k in range(p.shape[1]):  # the order of additions of `cosine`
            total += p[:, k] * q[:, k]
        return total

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        v = t["item"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids, block = t["id"].to_pylist(), t["block"].to_numpy()
        names = sorted(set(ids))
        turn = {s: k for k, s in enumerate(names)}
        rank, norm = np.array([turn[s] for s in ids], np.int64), np.sqrt(dots(v, v))
        one = t["x"][0].as_py() == t["y"][0].as_py()
        left = np.flatnonzero((block == t["x"][0].as_py()) & (norm > 0))
        right = left if one else np.flatnonzero((block == t["y"][0].as_py()) & (norm > 0))
        unit = v / np.where(norm > 0, norm, 1)[:, None]
        kept, floor = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), least
        for at in range(0, len(left), STRIP):
            some = left[at : at + STRIP]
            near = (unit[some] @ unit[right].T >= floor - 1e-9) & (rank[some][:, None] != rank[right][None, :])
            if one:
                near &= some[:, None] < right[None, :]
            i, j = (w[c] for w, c in zip((some, right), np.nonzero(near), strict=True))
            score = np.concatenate([dots(v[i[k : k + DOTS]], v[j[k : k + DOTS]]) for k in range(0, len(i), DOTS)] or [np.empty(0)]) / (norm[i] * norm[j])
            a, b, score = (np.concatenate(c) for c in zip(kept, (np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j]), score), strict=True))
            fit = score >= least
            a, b, score = a[fit], b[fit], score[fit]
            best = np.lexsort((-score, b, a))
            a, b, score = a[best], b[best], score[best]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, score = a[new], b[new], score[new]
            first = np.lexsort((b, a, -np.floor(score * 1e9 + 0.5)))[:many]
            kept = a[first], b[first], score[first]
            if len(first) == many:
                floor = max(least, kept[2].min() - 2e-9)
        return pa.table({"a": pa.array([names[k] for k in kept[0]], pa.string()), "b": pa.array([names[k] for k in kept[1]], pa.string()), "similarity": kept[2]})

    return run


def latent_words(docs: DataFrame, sets: DataFrame, edges: DataFrame, least: float = 0.70, limit: int = 10) -> DataFrame:
    """What latent_pairs gives for word sets (id, repository, item: array of distinct words) by Jaccard similarity, without pairs of all.

    Equal sets of a repository are one class, and classes meet, not their documents. Of two sets with a share of their words in common, the rarest words of each - all but that share, and one -
    have one in common: only sets that meet there are compared. Shares fall from 1 to `least`, until `limit` pairs are found that no pair of a lesser share can precede.
    """
    some = sets.where("id is not null and repository is not null and size(item) > 0").select("id", "repository", F.sort_array("item").alias("item"))
    # Words travel as numbers; two words with one number make candidates only, which the words themselves decide.
    some = some.withColumn("cls", F.sha2(F.to_json(F.struct("repository", "item")), 256))
    member = cut(some.select("cls", "id").distinct())
    classes = cut(some.select("cls", "repository", "item").dropDuplicates(["cls"]))
    linked = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    item = lambda x, y: classes.select(F.col("cls").alias(x), F.col("item").alias(y))
    own = member.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("p"), F.col("cls").alias("q"), F.lit(1.0).alias("similarity"))
    share, shared = 1.0, None
    while True:
        share = max(share, least)
        pairs = own
        if share < 1:
            shared = _rarest(classes) if shared is None else shared
            few = F.col("size") - F.ceil(F.col("size") * F.lit(share) - 1e-9) + 1 - (F.col("size") - F.size("ws"))
            first = shared.withColumn("few", few.cast("int")).where("few > 0").select("cls", "repository", "size", F.explode(F.slice("ws", 1, F.col("few"))).alias("w"))
            p, q = (first.select("repository", "w", F.col("cls").alias(x), F.col("size").alias(f"n{x}")) for x in "pq")
            near = p.join(q, ["repository", "w"]).where((F.col("p") < F.col("q")) & (F.least("np", "nq") >= F.greatest("np", "nq") * share - 1e-9)).select("p", "q").distinct()
            found = near.join(item("p", "x"), "p").join(item("q", "y"), "q").select("p", "q", jaccard("x", "y").alias("similarity")).where(F.col("similarity") >= share)
            pairs = own.union(found)
        if least > 1:
            pairs = own.limit(0)
        out = _first_members(cut(pairs), member, linked, limit)
        # A pair that is left out has a lesser similarity than share; rounding to nine digits must not make it equal.
        if share <= least or out.where(F.round("similarity", 9) > share).count() == limit or (share == 1 and out.count() == limit):
            return out.orderBy(F.desc(F.round("similarity", 9)), "a", "b")
        share = share - 0.2 if share < 1 else 0.9


def _rarest(classes: DataFrame) -> DataFrame:
    """(cls, repository, size, ws): of each class (cls, repository, item) its size and, as numbers, its words that others of the repository have, the rarest first."""
    words = classes.select("cls", "repository", F.size("item").alias("size"), F.explode(F.transform("item", lambda w: F.xxhash64(w))).alias("w"))
    often = words.groupBy("repository", "w").agg(F.count("*").alias("n")).where("n > 1")
    # A class's words that another has, the rarest first; the others come before them and share nothing.
    shared = words.join(often, ["repository", "w"]).groupBy("cls", "repository", "size").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ws"))
    return cut(shared.select("cls", "repository", "size", F.col("ws.w").alias("ws")))


def _first_members(pairs: DataFrame, member: DataFrame, linked: DataFrame, limit: int) -> DataFrame:
    """(a, b, similarity): the first unlinked pairs of members of pairs of classes (p, q, similarity), p = q for pairs within one.

    A member's pairs with the first of a class precede those with later ones: with `limit` first members, and as many more as one can be linked with, no later one is needed. Nor is a pair of classes whose first
    pair comes after `limit` unlinked first pairs of others.
    """
    order = [F.desc(F.round("similarity", 9)), "a", "b"]
    heads = member.groupBy("cls").agg(F.min("id").alias("head"))
    second = member.join(heads, "cls").where("id <> head").groupBy("cls").agg(F.min("id").alias("second"))
    of = lambda x: heads.select(F.col("cls").alias(x), F.col("head").alias(f"h{x}"))
    begun = pairs.join(of("p"), "p").join(of("q"), "q").join(second.select(F.col("cls").alias("p"), "second"), "p", "left")
    other = F.when(F.col("p") == F.col("q"), F.col("second")).otherwise(F.col("hq"))
    begun = cut(begun.select("p", "q", "similarity", F.least("hp", other).alias("a"), F.greatest("hp", other).alias("b")))
    one = begun.where("a <> b").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    free = short(one.join(linked, ["a", "b"], "left_anti").orderBy(*order).limit(limit))
    bound = free.orderBy(F.round("similarity", 9), F.desc("a"), F.desc("b")).first()
    if free.count() == limit:
        r = F.round("similarity", 9)
        last = free.select(F.min(r)).first()[0]
        begun = begun.where((r > last) | ((r == last) & ((F.col("a") < bound["a"]) | ((F.col("a") == bound["a"]) & (F.col("b") <= bound["b"])))))
    both = linked.select(F.col("a").alias("id"), F.col("b").alias("o")).union(linked.select("b", "a")).join(member.select("id").distinct(), "id", "left_semi")
    met = both.join(member.select(F.col("id").alias("o")).distinct(), "o", "left_semi")
    most = met.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] + limit + 1
    named = begun.select(F.col("p").alias("cls")).union(begun.select("q")).distinct()
    place = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
    firsts = cut(member.join(named, "cls", "left_semi").withColumn("k", place).where(F.col("k") <= most).select("cls", "id"))
    side = lambda x, y: firsts.select(F.col("cls").alias(x), F.col("id").alias(y))
    all_ = begun.select("p", "q", "similarity").join(side("p", "i"), "p").join(side("q", "j"), "q").where((F.col("p") != F.col("q")) | (F.col("i") < F.col("j")))
    all_ = all_.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "similarity")
    all_ = all_.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return short(all_.join(linked, ["a", "b"], "left_anti").orderBy(*order).limit(limit))


def latent(docs: DataFrame, vectors: DataFrame, words: DataFrame, edges: DataFrame, least: float = 0.70, limit: int = 10) -> DataFrame:
    """Unlinked pairs by their vectors (id, repository, item); where there are none, by their words."""
    if vectors.isEmpty():
        return latent_words(docs, words, edges, least, limit)
    return latent_vectors(docs, vectors, edges, least, limit)
