"""What the operators of this folder share: table access, lineage cuts, word and shingle hashing."""

from __future__ import annotations

import ctypes
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here, `[\x20\x09-\x0D]`; bytes.split() splits at the same six.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A session without one gets a temporary folder if its executors are in this process (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = named or tempfile.mkdtemp(prefix="quillstone-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return spark.conf.get("spark.checkpoint.dir", None) or named


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends, and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Deletes the files of a checkpoint (a frame that `cut` gave) that nothing will read again."""
    named = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if named.isDefined():
        delete(df.sparkSession, named.get())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x20\\x09-\\x0D]+`."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes (as int64) of the k-word shingles; a shorter text is one shingle, no words none."""
    h = word_hashes(words_of(text))
    if not len(h):
        return np.empty(0, np.int64)
    k = min(k, len(h))
    m = len(h) - k + 1
    a = h[:m] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    for j in range(1, k):
        a ^= a >> np.uint64(29)
        a *= np.uint64(0xBF58476D1CE4E5B9)
        a += h[j : j + m]
    a ^= a >> np.uint64(32)
    a *= np.uint64(0x94D049BB133111EB)
    a ^= a >> np.uint64(29)
    return np.unique(a.view(np.int64))


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit keys for a whole shingle set."""
    h = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64, copy=False)))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable over `edges` (a, b: longs), for nodes with an edge.

    Alternating large-star and small-star rounds: every edge moves to the smallest neighbour, so the
    rounds grow with the logarithm of the longest chain. Each round is two aggregations with map-side
    combine and joins on node ids; hot nodes are split by the skew join. Lineage is cut every round.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        last, e = e, cut(small.distinct())
        release(last)
        now = e.agg(F.count("*"), F.bit_xor("v"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not converge")
    tops = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(tops)


_kept: dict[tuple, tuple] = {}
_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None


def kept(key: tuple, make: Callable, close: Callable):
    """What a Python worker keeps between tasks under a key, whose first part names its operator."""
    if key not in _kept:
        _kept[key] = (make(), close)
    return _kept[key][0]


def let_go(but: str | None) -> None:
    """Closes and drops what the worker keeps for operators other than `but`: workers are used again by later stages."""
    for key in [k for k in _kept if k[0] != but]:
        value, close = _kept.pop(key)
        close(value)


def trim() -> None:
    """Gives memory that is free in this process back: Python workers stay between stages, and an executor pays for all of them."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def arrow_map(df: DataFrame, fn, schema: str, keeps: str | None = None) -> DataFrame:
    """mapInArrow that skips empty batches; keeps: the operator whose kept objects the tasks use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        trim()
        yield from fn(b for b in batches if b.num_rows)
        trim()

    return df.mapInArrow(run, schema)
