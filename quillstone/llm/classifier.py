"""Operator 10: quality classifier by co-training on two views.

The text view sees a document's words (hashed) and statistics of its text; the metadata view sees source, language, length and line
structure. Both are logistic regressions. In each round, each view labels the pool documents of which it is most confident for the *other* view.
Afterwards each view's margin is calibrated on labelled documents that trained neither, and the calibrated log odds are combined by a
logistic regression on the same documents. All documents are scored by one scan with the two weight vectors (fixed size).

All labels are read, and all documents without a label are the pool. Labelled documents and pool are dealt by a seeded hash of the id into blocks of
about BLOCK labelled and POOL pool documents at most; each block is co-trained in a task of its own, and the model's weights are the means of the blocks'.
A class of which a block would get fewer than LEAST documents goes to several blocks. One in HELD labelled documents trains nothing and calibrates.
The driver sees the mean weights, counts of held documents by rounded margins, and the least scores that set the threshold. A document is good if quality = 1
and toxic = 0. It is rejected if its combined score is below the threshold: the lesser of 0.5 and the score that `keep` of the good calibration documents reach.

Defined results. Null or empty text: features of no words; scored by the rest. Null source or lang: a value of its own. Labels with nulls or conflicting labels
of a document: it is in the pool. No labels, or all alike: score 0.5 for all, all kept. Null doc_id: scored as any, trains nothing. Repeated rows: each is
returned. Extra columns are ignored by the query and passed through by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_map, cut, let_go, release, trim

WORD_BITS = 16
#: Labelled and pool documents of a block, and of a class at least.
BLOCK, POOL, LEAST = 4000, 16000, 100
#: One labelled document in so many calibrates.
HELD = 5
#: Weights are added as integers of this scale, so that their order doesn't matter.
UNIT = 2.0**32
META_BITS = 12
N_STATS = 9
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def text_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words, and statistics scaled to about [0, 1]."""
    mask = (1 << WORD_BITS) - 1
    words = raw.translate(_LETTERS).split()
    distinct = set(words)
    ids = np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) & mask for w in distinct), np.int64, len(distinct)))
    n, given = max(1, len(raw)), raw.split()
    flat = np.frombuffer(raw, np.uint8)
    count = np.bincount(flat, minlength=256) if len(flat) else np.zeros(256, np.int64)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    symbols = sum(int(count[c]) for c in b"#*$%&|<>")
    stats = [
        min(1.0, 10 * symbols / n),
        upper / max(1, upper + lower),
        min(1.0, 20 * int(count[33]) / n),
        len(distinct) / max(1, len(words)),
        min(1.0, len(raw) / max(1, len(given)) / 20),
        min(1.0, 20 * int(count[124]) / n),
        min(1.0, 10 * count[48:58].sum() / n),
        min(1.0, np.log1p(len(given)) / 10),
        len({*raw.split(b"\n")}) / (1 + int(count[10])),
    ]
    return ids, np.array(stats)


def meta_features(raw: bytes, source: str | None, lang: str | None) -> np.ndarray:
    size, lines = int(2 * np.log2(1 + len(raw))), int(2 * np.log2(1 + raw.count(b"\n")))
    facts = (f"s={source}", f"l={lang}", f"n={size}", f"b={lines}", f"d={size - lines}", f"ls={lang},{size}")
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x) & ((1 << META_BITS) - 1) for x in facts], np.int64))


@dataclass
class Linear:
    """Logistic regression over sparse 0/1 features (scaled by how much each tells) and dense ones."""

    words: np.ndarray
    stats: np.ndarray
    bias: float

    def margin(self, ids: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        lengths = np.array([len(i) for i in ids])
        sums = np.zeros(len(ids))
        if lengths.sum():
            owner = np.repeat(np.arange(len(ids)), lengths)
            sums = np.bincount(owner, self.words[np.concatenate(ids)], minlength=len(ids))
        return sums + stats @ self.stats + self.bias


def fit(ids: list[np.ndarray], stats: np.ndarray, y: np.ndarray, size: int, steps: int = 120, ridge: float = 2e-3) -> Linear:
    """Both classes weigh the same. Words are scaled by their smoothed log ratio in bad and good documents, then weighed by Adam."""
    lengths = np.array([len(i) for i in ids])
    owner, flat = np.repeat(np.arange(len(ids)), lengths), np.concatenate(ids) if lengths.sum() else np.empty(0, np.int64)
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    p = np.bincount(flat, y[owner], minlength=size)
    q = np.bincount(flat, 1 - y[owner], minlength=size)
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    # A word seen a few times tells little: shrink its ratio by its count.
    ratio *= (p + q) / (p + q + 10)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    s, b = np.zeros(stats.shape[1]), 0.0
    # Only words that occur have a gradient. A document's words lie side by side in flat, a word's documents in holders.
    seen, flat, often = np.unique(flat, return_inverse=True, return_counts=True)
    holders, heads = owner[np.argsort(flat, kind="stable")], np.cumsum(often) - often
    ratio, w = ratio[seen], np.zeros(len(seen))
    some = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[some]
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(s), np.zeros_like(s)], [0.0, 0.0]]
    for t in range(1, steps + 1):
        z = stats @ s + b
        if len(some):
            z[some] += np.add.reduceat((w * ratio)[flat], starts)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        told = np.add.reduceat(g[holders], heads) if len(heads) else np.zeros(0)
        grads = [told * ratio + ridge * w / size**0.5, stats.T @ g + ridge * s * 0.01, g.sum()]
        new = []
        for k, (value, grad) in enumerate(zip((w, s, b), grads, strict=True)):
            m = moments[k]
            m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * grad**2
            rate = 0.3 if k else 0.05
            new.append(value - rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8))
        w, s, b = new
    words = np.zeros(size)
    words[seen] = w * ratio
    return Linear(words, s, float(b))


def calibrate(x: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0, steps: int = 200) -> np.ndarray:
    """Coefficients and bias of a small logistic regression by Newton's method with a light ridge; n: how often each row stands."""
    a = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(c)), a.T @ (n * (p - y)) + 1e-2 * c)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return c


@dataclass
class Model:
    text: Linear
    meta: Linear
    text_scale: np.ndarray
    meta_scale: np.ndarray
    joint: np.ndarray
    threshold: float

    def score(self, ids: list[np.ndarray], stats: np.ndarray, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of a good document: text view, metadata view, combined."""
        zt = self.text.margin(ids, stats) * self.text_scale[0] + self.text_scale[1]
        zm = self.meta.margin(meta, np.zeros((len(meta), 1))) * self.meta_scale[0] + self.meta_scale[1]
        zj = zt * self.joint[0] + zm * self.joint[1] + self.joint[2]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zt, zm, zj))


def cotrain(ids, stats, meta, y: np.ndarray, rounds: int = 3, sure: float = 0.95, share: float = 0.05) -> list[Linear] | None:
    """Text and metadata view of a block; y: 1 good, 0 bad, -1 unlabelled (pool). None if the labels are all alike.

    A round gives the other view, of each class, at most `share` as many pool documents as there are labelled ones.
    """
    train, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    if not len(train) or min(np.bincount(y[train].astype(int), minlength=2)) == 0:
        return None
    own: list[dict[int, int]] = [{i: int(y[i]) for i in train.tolist()} for _ in range(2)]
    none = np.zeros((len(y), 1))
    most = max(1, int(share * len(train)))
    for turn in range(rounds + 1):
        views = []
        for v, (f, d, size) in enumerate(((ids, stats, 1 << WORD_BITS), (meta, none, 1 << META_BITS))):
            at = np.fromiter(own[v], np.int64)
            views.append(fit([f[i] for i in at], d[at], np.array([own[v][i] for i in at], float), size))
        if turn == rounds:
            break
        for v, (f, d) in enumerate(((ids, stats), (meta, none))):
            other = own[1 - v]
            left = np.array([i for i in pool.tolist() if i not in other], np.int64)
            if not len(left):
                continue
            c = calibrate(views[v].margin([f[i] for i in train], d[train])[:, None], y[train])
            p = 1 / (1 + np.exp(-np.clip(views[v].margin([f[i] for i in left], d[left]) * c[0] + c[1], -30, 30)))
            for label, q in ((1, p), (0, 1 - p)):
                best = np.argsort(-q, kind="stable")[:most]
                other.update((int(left[i]), label) for i in best if q[i] >= sure)
    return views


_FEATURES = "doc_id long, turn long, words binary, stats binary, meta binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features as bytes of 16-bit numbers and doubles: a fraction of the texts."""
    for batch in batches:
        words, stats, meta = [], [], []
        for t, s, la in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            w, d = text_features(t or b"")
            words.append(w.astype("<u2").tobytes()), stats.append(d.astype("<f8").tobytes()), meta.append(meta_features(t or b"", s, la).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), *(pa.array(x, pa.binary()) for x in (words, stats, meta))], names=["doc_id", "turn", "words", "stats", "meta"])


def _unpack(rows: pa.Table | pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    words, meta = ([np.frombuffer(x, "<u2").astype(np.int64) for x in rows.column(c).to_pylist()] for c in ("words", "meta"))
    return words, np.frombuffer(b"".join(rows.column("stats").to_pylist()), "<f8").reshape(-1, N_STATS), meta


def _views(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))


def _places(views: list[Linear]) -> np.ndarray:
    """All numbers of both views, one after the other."""
    return np.concatenate([x for v in views for x in (v.words, v.stats, [v.bias])])


def _of_places(flat: np.ndarray) -> list[Linear]:
    out = []
    for size, n in ((1 << WORD_BITS, N_STATS), (1 << META_BITS, 1)):
        out.append(Linear(flat[:size], flat[size : size + n], float(flat[size + n])))
        flat = flat[size + n + 1 :]
    return out


def labelled_features(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, words, stats, meta, y, held) of every document with an id: y 1 good, 0 bad, -1 without a label or with conflicting ones."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    clean = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("y"), F.max(good.cast("int")).alias("z")).where("y = z")
    # Of rows that share an id the one with the least hash is read, so that reruns agree.
    rows = arrow_map(_views(docs).where("doc_id is not null").withColumn("turn", F.xxhash64("text", "source", "lang")), _features, _FEATURES)
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("words", "stats", "meta"), "turn").alias("v")).select("doc_id", "v.*")
    held = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(HELD)) == 0
    return one.join(clean.select("doc_id", "y"), "doc_id", "left").select("doc_id", "words", "stats", "meta", F.coalesce("y", F.lit(-1)).alias("y"), (held & F.col("y").isNotNull()).alias("held"))


def blocks_of(rows: DataFrame, sizes: dict[tuple[int, bool], int], seed: int = 7) -> DataFrame:
    """The rows that train and the pool, with the block of each; sizes: rows by (y, held)."""
    known = sum(n for (y, _), n in sizes.items() if y >= 0)
    n = max(1, -(-known // BLOCK), -(-sizes.get((-1, False), 0) // POOL))
    copies = F.lit(1)
    for y in (0, 1):
        copies = F.when(F.col("y") == y, min(n, -(-LEAST * n // max(1, sizes.get((y, False), 0))))).otherwise(copies)
    first = F.xxhash64(F.lit(seed), "doc_id")
    dealt = rows.where("not held").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.withColumn("block", F.pmod(F.pmod(first, F.lit(n)) + F.col("copy"), F.lit(n)).cast("int"))


def train(docs: DataFrame, labels: DataFrame, keep: float = 0.995, seed: int = 7, **options) -> Model | None:
    """The model of all labels and documents; options go to cotrain()."""
    rows = cut(labelled_features(docs, labels, seed))
    sizes = {(r.y, r.held): r["count"] for r in rows.groupBy("y", "held").count().collect()}
    if sizes.get((0, True), 0) + sizes.get((1, True), 0) < 4 or not all(sizes.get((y, h)) for y in (0, 1) for h in (False, True)):
        release(rows)
        return None

    def one(block: pa.Table) -> pa.Table:
        let_go(None)
        block = block.sort_by("doc_id")
        views = cotrain(*_unpack(block), block.column("y").to_numpy().astype(float), **options)
        trim()
        flat = np.rint(_places(views) * UNIT).astype(np.int64) if views else np.empty(0, np.int64)
        # The last place counts blocks.
        at = np.append(np.flatnonzero(flat), len(flat)) if views else np.empty(0, np.int64)
        return pa.table({"place": pa.array(at, pa.int64()), "w": pa.array(np.append(flat, 1)[at] if views else flat, pa.int64())})

    found = blocks_of(rows, sizes, seed).groupBy("block").applyInArrow(one, "place long, w long").groupBy("place").agg(F.sum("w").alias("w")).toArrow()
    flat = np.zeros((1 << WORD_BITS) + N_STATS + 1 + (1 << META_BITS) + 2)
    place, w = found.column("place").to_numpy(), found.column("w").to_numpy()
    if not len(w):
        release(rows)
        return None
    total = w[place == len(flat)][0]
    flat[place[place < len(flat)]] = w[place < len(flat)] / UNIT / total
    text, meta = _of_places(flat)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, stats, facts = _unpack(b)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(text.margin(ids, stats)), pa.array(meta.margin(facts, np.zeros((len(facts), 1))))], names=["y", "t", "m"])

    held = cut(arrow_map(rows.where("held").select("y", "words", "stats", "meta"), margins, "y int, t double, m double"))
    release(rows)

    def fitted(steps: int, *by) -> np.ndarray:
        """A calibration on counts of held documents by values rounded to 1/steps: at most (64 * steps + 1) of each."""
        cells = held.groupBy("y", *(F.rint(F.least(F.greatest(c, F.lit(-32.0)), F.lit(32.0)) * steps).alias(f"c{k}") for k, c in enumerate(by))).count().orderBy("y", *(f"c{k}" for k in range(len(by)))).toArrow()
        x = np.column_stack([cells.column(f"c{k}").to_numpy() / steps for k in range(len(by))])
        return calibrate(x, cells.column("y").to_numpy().astype(float), cells.column("count").to_numpy().astype(float))

    ct, cm = fitted(256, F.col("t")), fitted(256, F.col("m"))
    zt, zm = F.col("t") * float(ct[0]) + float(ct[1]), F.col("m") * float(cm[0]) + float(cm[1])
    joint = fitted(16, zt, zm)
    last = int((1 - keep) * sizes[1, True])
    least = held.where("y = 1").select((zt * float(joint[0]) + zm * float(joint[1]) + float(joint[2])).alias("z")).orderBy("z").limit(last + 1).agg(F.max("z")).first()[0]
    release(held)
    return Model(text, meta, ct, cm, joint, float(min(0.5, 1 / (1 + np.exp(-np.clip(least, -30, 30))))))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None:
                got = (np.full(n, 0.5),) * 3
            else:
                f = [text_features(t or b"") for t in batch.column(1).to_pylist()]
                meta = [meta_features(t or b"", s, la) for t, s, la in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                got = model.score([x[0] for x in f], np.array([x[1] for x in f]), meta)
            kept = got[2] >= (model.threshold if model else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(g) for g in got), pa.array(kept)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return arrow_map(_views(docs), run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""

    @F.pandas_udf("boolean")
    def good(text, source, lang):
        import pandas as pd

        if model is None or not len(text):
            return pd.Series(np.ones(len(text), bool))
        raw = [t or b"" for t in text]
        f = [text_features(t) for t in raw]
        meta = [meta_features(t, s, la) for t, s, la in zip(raw, source, lang, strict=True)]
        return pd.Series(model.score([x[0] for x in f], np.array([x[1] for x in f]), meta)[2] >= model.threshold)

    return docs.where(good(F.col("text").cast("binary"), F.col("source").cast("string"), F.col("lang").cast("string")))
