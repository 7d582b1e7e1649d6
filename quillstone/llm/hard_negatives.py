"""Operator 13: hard-negative mining over k-means inverted lists with stored centroids and radii.

A k-means model, fitted on at most SAMPLE rows, files every row under its nearest centroid; a list's radius is the largest distance
of its rows from the centroid. By Cauchy-Schwarz a row x of a list scores at most a.c + |a| r and at least a.c - |a| r with an anchor a. Searches
run in rounds of ever more lists, by upper bound: a round sends each query to the lists that it still needs, lists answer in blocks of at
most about BLOCK rows, and a query ends once the next bound falls strictly below its k-th score. For negatives, lists that lie outside of the
window of scores are skipped, and the bound counts up to the window's end.

Rows of one vector and label differ by id alone: only the least of their ids can be in an answer, and anchors of one vector and label are one query. Scores are
integer: products of whole numbers, summed exactly (as doubles where they can't pass 2^53, as Python integers beyond).

Defined results. Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as ended by zeros. An id that stands more
than once counts once, by its least label and then vector. Scores beyond a long are given as the nearest long, and rank as that. Fewer than the asked rows: all of them; none: no row. Ties go by the
lesser id. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_map, cut
from quillstone.llm.topk import _first_k

#: Rows that the model is fitted on, rows of a list and of a block, most lists, queries that travel together, lists of the first round and growth of later ones.
SAMPLE, LIST, BLOCK, LISTS, TOGETHER, FIRST, GROWTH = 16_384, 1024, 2048, 1024, 512, 4, 4
EXACT, LONG = float(1 << 53), (1 << 63) - 1
FLUSH = 200_000


def whole_vectors(rows: DataFrame, key: str, label: Column, vector: str, times: float = 256.0) -> DataFrame:
    """(id, label, x): each component becomes floor(times * component), as a double; rows that can take part only."""
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157e308D)"
    y = f"least(greatest(cast(x as double) * {times}D, -1.7976931348623157e308D), 1.7976931348623157e308D)"
    # floor() of a double is a long in SQL; the difference from the remainder has no such limit.
    q = f"transform({vector}, x -> rint({y} - pmod({y}, 1D)) + 0D)"
    some = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.expr(vector)).where(f"id is not null and label is not null and {vector} is not null and {finite}")
    return some.select("id", "label", F.expr(q).alias("x"))


def _meet(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that no side of is broadcast: Spark counts an array of doubles as one, a block of vectors as 100 bytes, and would send gigabytes through the driver."""
    return a.join(b.hint("merge"), on, how)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole rows, exact, as longs."""
    with np.errstate(over="ignore"):
        largest = np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0)
    if largest < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    return np.array([[min(max(sum(map(int.__mul__, p, q)), -LONG), LONG) for q in whole[1]] for p in whole[0]], np.int64)


class Lists:
    """The inverted lists: centroids and radii (at most LISTS of them), and the lists' rows in blocks."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray, blocks: DataFrame, dim: int):
        self.centroids, self.radii, self.blocks, self.dim = centroids, radii, blocks, dim

    @classmethod
    def build(cls, rows: DataFrame, n: int, dim: int) -> Lists:
        """Lists of rows (id, label, x), n in number."""
        share = min(1.0, SAMPLE / max(n, 1))
        fit = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(array_to_vector("x").alias("features"))
        k = min(LISTS, n // LIST)
        centroids = np.array(KMeans(k=k, maxIter=5, initMode="random", seed=7).fit(fit).clusterCenters()) if k > 1 else np.zeros((1, dim))

        def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            norms = (centroids**2).sum(1)
            for b in batches:
                x = _matrix(b.column("x"), dim)
                with np.errstate(all="ignore"):
                    at = np.argmin(norms - 2 * (x @ centroids.T), axis=1)
                    far = np.sqrt(((x - centroids[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(np.nan_to_num(far, nan=np.inf))], ["id", "label", "x", "list", "far"])

        filed = cut(arrow_map(rows, nearest, "id long, label long, x array<double>, list int, far double"))
        facts = filed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # LISTS rows at most
        radii, parts = np.full(len(centroids), -1.0), {}
        for f in facts:
            radii[f["list"]], parts[f["list"]] = f["far"], -(-f["n"] // BLOCK)
        several = F.get(F.lit([parts.get(at, 1) for at in range(len(centroids))]), F.col("list"))

        def pack(group: pa.Table) -> pa.Table:
            t = group.sort_by("id").combine_chunks()
            return pa.table({"list": t["list"][:1], "ids": [t["id"].to_numpy().tobytes()], "labels": [t["label"].to_numpy().tobytes()], "xs": [_matrix(t["x"].combine_chunks(), dim).tobytes()]})

        keyed = filed.withColumn("block", F.pmod(F.xxhash64("id"), several))
        blocks = cut(keyed.groupBy("list", "block").applyInArrow(pack, "list int, ids binary, labels binary, xs binary"))
        return cls(centroids, radii, blocks, dim)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the scores of each row of x with each list; a margin covers rounding. Empty lists have upper bounds of -inf."""
        with np.errstate(all="ignore"):
            at, size = x @ self.centroids.T, np.linalg.norm(x, axis=1)[:, None]
            reach = size * self.radii + 1e-9 * size * (np.linalg.norm(self.centroids, axis=1) + self.radii + 1)
            up = np.where(self.radii < 0, -np.inf, np.nan_to_num(at + reach, nan=np.inf, posinf=np.inf, neginf=-np.inf))
            return up, np.nan_to_num(at - reach, nan=-np.inf, posinf=np.inf, neginf=-np.inf)

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, p, score, id): the first k rows of a query, by score and id, that have its label (same) or another, with lo <= score <= hi. queries: (q, label, x, windows: array of (p, lo, hi))."""
        spark, dim, plan = queries.sparkSession, self.dim, (self.centroids, self.radii)
        groups = -(-queries.count() // TOGETHER)
        asked = cut(queries.select(F.pmod(F.xxhash64("q"), F.lit(max(groups, 1))).alias("g"), "q", "label", "x", F.explode("windows").alias("w")).select("g", "q", "label", "x", "w.p", "w.lo", "w.hi"))
        found, done = None, 0
        while done < len(plan[0]):
            upto = max(FIRST, done * GROWTH)
            if found is None:
                state = asked.withColumn("kth", F.lit(None).cast("long"))
            else:
                kth = found.groupBy("q", "p").agg(F.min("score").alias("kth"), F.count("*").alias("n")).select("q", "p", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
                state = _meet(asked, kth, ["q", "p"], "left").select(*asked.columns, "kth")
            visits = self._visits(state, done, upto)
            if found is not None and visits.isEmpty():
                break
            hits = arrow_map(_meet(visits, self.blocks, ["list"]), _answers(k, same, dim), "q long, p long, score long, id long")
            best = hits if found is None else found.union(hits)
            found = cut(_first_k(best.withColumn("__fall", -F.col("score")), ["q", "p"], ["__fall", "id"], k).drop("__r", "__fall"))
            done = upto
        return found if found is not None else spark.createDataFrame([], "q long, p long, score long, id long")

    def _visits(self, state: DataFrame, done: int, upto: int) -> DataFrame:
        """(list, qs, labels, xs, windows): for each list, the queries of a group that go there now: those for which it is among the lists done to upto by bound."""
        dim, bounds = self.dim, Lists(self.centroids, self.radii, None, self.dim).bounds

        def plan(group: pa.Table) -> pa.Table:
            t = group.sort_by([("q", "ascending"), ("p", "ascending")]).combine_chunks()
            q, p, lo, hi = (t[c].to_numpy() for c in ("q", "p", "lo", "hi"))
            kth = t["kth"].to_numpy(zero_copy_only=False).astype(float)
            _, first, row = np.unique(q, return_index=True, return_inverse=True)
            x, label = _matrix(t["x"].combine_chunks().take(pa.array(first)), dim), t["label"].to_numpy()[first]
            up, low = (b[row] for b in bounds(x))
            outside = (up < lo[:, None]) | (low > hi[:, None])
            up = np.where(outside, -np.inf, np.minimum(up, hi[:, None]))
            place = np.argsort(np.argsort(-up, axis=1, kind="stable"), axis=1)
            go = (place >= done) & (place < upto) & (up > -np.inf) & ~(up < kth[:, None])
            out = []
            for at in np.flatnonzero(go.any(0)):
                w = np.flatnonzero(go[:, at])
                rows, index = np.unique(row[w], return_inverse=True)
                out.append({"list": int(at), "qs": q[first][rows].tobytes(), "labels": label[rows].tobytes(), "xs": x[rows].tobytes(), "windows": np.stack([index, p[w], lo[w], hi[w]]).astype(np.int64).tobytes()})
            return pa.Table.from_pylist(out, pa.schema([("list", pa.int32()), *((c, pa.binary()) for c in ("qs", "labels", "xs", "windows"))]))

        visits = state.groupBy("g").applyInArrow(plan, "list int, qs binary, labels binary, xs binary, windows binary")
        return visits.withColumnsRenamed({"qs": "q_ids", "labels": "q_labels", "xs": "q_xs"})


def _answers(k: int, same: bool, dim: int):
    """For each pair of a visit and a block, each query's first k rows; a task keeps the first k of a query over many blocks."""

    def first(kept: list[tuple]) -> list[np.ndarray]:
        q, p, score, id_ = (np.concatenate(c) for c in zip(*kept))
        order = np.lexsort((id_, -score, p, q))
        q, p, score, id_ = (c[order] for c in (q, p, score, id_))
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (p[1:] != p[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        few = np.arange(len(q)) - start < k
        return [c[few] for c in (q, p, score, id_)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            for r in range(b.num_rows):
                qs, q_labels, q_xs, windows, ids, labels, xs = (b.column(c)[r].as_py() for c in ("q_ids", "q_labels", "q_xs", "windows", "ids", "labels", "xs"))
                qs, q_labels, ids, labels = (np.frombuffer(a, np.int64) for a in (qs, q_labels, ids, labels))
                index, p, lo, hi = np.frombuffer(windows, np.int64).reshape(4, -1)
                score = _scores(np.frombuffer(q_xs).reshape(-1, dim), np.frombuffer(xs).reshape(-1, dim))
                before = -1
                for w in np.argsort(index, kind="stable"):
                    at = index[w]
                    if at != before:  # windows of one query share its order: rows by score, then id
                        mine = np.flatnonzero((labels == q_labels[at]) == same)
                        falling = -score[at, mine]
                        order = np.argsort(falling, kind="stable")
                        falling, before = falling[order], at
                    a = np.searchsorted(falling, -hi[w], "left")
                    z = min(a + k, np.searchsorted(falling, -lo[w], "right"))
                    if a < z:
                        got = mine[order[a:z]]
                        kept.append((np.full(z - a, qs[at]), np.full(z - a, p[w]), score[at, got], ids[got]))
                        n += z - a
                if n > FLUSH:
                    kept = [tuple(first(kept))]
                    n = len(kept[0][0])
                    if n > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept[0]], ["q", "p", "score", "id"])
                        kept, n = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in first(kept)], ["q", "p", "score", "id"])

    return run


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of rows (id, label, x of whole doubles) for the anchors among them.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first positives of its label, the first
    negatives of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    once = cut(rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x"))
    n, dim = once.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    dim = max(dim, 1)
    same_length = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("x")))
    once = once.withColumn("x", F.when(F.size("x") < dim, same_length).otherwise(F.col("x")))
    members = cut(_first_k(once, ["label", "x"], ["id"], positives + 1).drop("__r"))
    lists = Lists.build(members, n, dim)
    anchors = once.where(anchor)
    asked = cut(anchors.groupBy("label", "x").agg(F.min("id").alias("q")))
    of = _meet(anchors, asked, ["label", "x"]).select(F.col("id").alias("anchor_id"), "q")
    every = F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(-LONG).alias("lo"), F.lit(LONG).alias("hi")))
    near = lists.search(asked.select("q", "label", "x", every.alias("windows")), positives + 1, True)
    # A positive's score p opens the window from ceil(low * p / 100) to floor(high * p / 100); it holds nothing below 0.
    p = F.col("score").cast("decimal(25,0)")
    window = F.struct(F.col("score").alias("p"), F.ceil(p * low / 100).cast("long").alias("lo"), F.floor(p * high / 100).cast("long").alias("hi"))
    windows = near.where("score >= 0").groupBy("q").agg(F.collect_set(window).alias("windows"))
    far = lists.search(_meet(asked, windows, ["q"]).select("q", "label", "x", "windows"), negatives, False)
    pairs = near.groupBy("q").agg(F.expr("array_sort(collect_list(struct(-score as s, id)))").alias("all"))
    chosen = _meet(of, pairs, ["q"]).select("anchor_id", "q", F.explode(F.expr(f"slice(filter(all, r -> r.id <> anchor_id), 1, {positives})")).alias("r"))
    ranked = far.groupBy("q", "p").agg(F.expr("array_sort(collect_list(struct(-score as s, id)))").alias("found"))
    out = _meet(chosen.select("anchor_id", "q", F.col("r.id").alias("positive_id"), (-F.col("r.s")).alias("p")), ranked, ["q", "p"])
    out = out.select("anchor_id", "positive_id", F.col("p").alias("positive_score"), F.posexplode("found").alias("at", "f"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("negative_id"), "positive_score", (-F.col("f.s")).alias("negative_score"))
