"""Operator 5: token counts kept up to date by signed deltas.

A *rollup* is a folder with a folder of partial totals for each committed batch. A batch's change rows (insert, delete, revise)
become signed sums by (source, lang, tokenizer); a commit writes them to the batch's own folder and is
finished by the writer's success marker. Committing a batch again is a no-op, an unfinished commit
is not read and is written anew: so a job may be run again after any loss. Totals are sums over the finished batches;
`compact` folds them into one.

Change rows: op ('insert', 'delete' or 'revise'), source, lang, tokenizer, n_tokens, n_before (the count that a revision replaces or a delete takes back).

Defined results. Null source or lang: a group of its own (null). Null text: 0 tokens, and counts as a document. Repeated rows
are documents of their own. Groups whose documents have all been deleted stay with zeros. Extra columns are ignored. An empty batch
is committed and changes nothing. An op other than the three, or a null one, is an error, and nothing of its batch is committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bpe import read_ranks
from quillstone.llm.common import shared_dir

SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
CHANGE = "op string, source string, lang string, tokenizer string, n_tokens long, n_before long"


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def batches(self) -> list[str]:
        """Names of the finished batches, also of those that a compaction has put together."""
        fs, at = self._files(self.path)
        if not fs.exists(at):
            return []
        return sorted({*self._own(), *(r["batch"] for r in self._folded().collect())})

    def _own(self) -> list[str]:
        """The finished batches that have a folder here."""
        fs, at = self._files(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()] if fs.exists(at) else []
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and fs.exists(self._files(f"{self.path}/{n}/_SUCCESS")[1]))

    def _folded(self) -> DataFrame:
        """(batch): those that a compaction has put together."""
        fs, at = self._files(f"{self.path}/folded/_SUCCESS")
        return self.spark.read.schema("batch string").parquet(f"{self.path}/folded") if fs.exists(at) else self.spark.createDataFrame([], "batch string")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Writes a batch's signed sums; False if it had been committed."""
        if batch in self.batches():
            return False
        before = F.coalesce(F.col("n_before"), F.lit(0))
        tokens = F.when(F.col("op") == "insert", F.col("n_tokens")).when(F.col("op") == "delete", -before).when(F.col("op") == "revise", F.col("n_tokens") - before)
        tokens = tokens.otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("long"))
        docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
        sums = changes.groupBy("source", "lang", "tokenizer").agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the finished batches."""
        done = self._own()
        if not done:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/batch={b}" for b in done))
        return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self, path: str) -> Rollup:
        """A new rollup with these totals as its one batch; it knows the old batches' names, so that none is counted again."""
        fresh = Rollup(self.spark, path)
        self.spark.createDataFrame([(b,) for b in self.batches()], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{fresh.path}/folded")
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{fresh.path}/batch=compacted")
        return fresh


_encodings: dict[str, tiktoken.Encoding] = {}


def _encoding(path: str) -> tiktoken.Encoding:
    if path not in _encodings:
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encodings[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, lang, guess, n_tokens): exact counts of the vocabulary at `path`, and the guess of a quarter of the characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(path)
        for batch in batches:
            n = [len(own.encode_ordinary(t.decode("utf-8", "replace"))) if t else 0 for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "guess", "n_tokens"])

    guess = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("guess")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), guess, F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(lambda it: run(b for b in it if b.num_rows), "doc_id long, source string, lang string, guess long, n_tokens long")


def maintained_counts(docs: DataFrame, withdrawn: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Totals after three batches and a repeated one: guessed counts on arrival, revised to exact ones, less withdrawn documents.

    withdrawn: doc_id of documents to delete, each once. n_docs and n_tokens are thus those of the documents that are left.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    name = F.lit(tokenizer).alias("tokenizer")
    guess = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("n_tokens")
    arrived = docs.select(F.lit("insert").alias("op"), "source", "lang", name, guess, F.lit(None).cast("long").alias("n_before"))
    rollup.commit("arrived", arrived)
    # The exact counts are computed once and kept, as they serve the revision and the deletion.
    kept = f"{rollup.path}/counts"
    count_tokens(docs, path).write.mode("overwrite").parquet(kept)
    exact = spark.read.parquet(kept)
    revised = exact.select(F.lit("revise").alias("op"), "source", "lang", name, "n_tokens", F.col("guess").alias("n_before"))
    rollup.commit("revised", revised)
    gone = exact.join(withdrawn.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    deleted = gone.select(F.lit("delete").alias("op"), "source", "lang", name, F.lit(None).cast("long").alias("n_tokens"), F.col("n_tokens").alias("n_before"))
    rollup.commit("withdrawn", deleted)
    rollup.commit("revised", revised)  # a rerun of a finished batch changes nothing
    return rollup.totals()
