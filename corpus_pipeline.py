"""A training corpus from `documents` in five stages, each by one of the operators in quillstone.llm.

run(spark, sf_dir) applies STAGES in order; each works on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, classifier, mixing, ngram_join, substring_dedup
from quillstone.llm.common import SPACE, delete, shared_dir, table


def _hashable(column: Column, kind: str) -> Column:
    """A column as one that can be hashed: a map by its sorted entries, one inside of something else as JSON."""
    if "map<" not in kind:
        return column
    return F.array_sort(F.map_entries(column)) if kind.startswith("map<") and "map<" not in kind[4:] else F.to_json(F.struct(column))


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts are scored by their metadata; equal rows, ties and repeated ids get equal verdicts. Without labels all stay. Extra columns are passed through.
    """
    return classifier.keep_good(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8) one row stays: that of the least id, null last.

    Rows are told apart by all their columns, maps by their entries (128 bits), so texts that share an id have a verdict each; of equal rows one stays.
    Texts without words are linked with nothing: all of them stay. Extra columns are passed through.
    """
    own = [_hashable(F.col(f"`{c}`"), kind) for c, kind in docs.dtypes]
    facts = [x for c in own for x in (c.isNull(), c)]
    K1, K2 = (_fresh(docs, c) for c in ("row_key", "row_key_too"))
    keyed = docs.withColumns({K1: F.xxhash64(*facts), K2: F.xxhash64(F.lit(1), *facts)})
    found = ngram_join.ngram_components(keyed, words=5, num=80, den=100, carry=(K1, K2))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", K1, K2)
    best = found.where("n_shingles > 0").groupBy("label").agg(F.min(order).alias("b")).select(f"b.{K1}", f"b.{K2}")
    some = F.length(F.translate(F.coalesce(F.col("text"), F.lit("")), SPACE, "")) > 0
    # Equal rows meet in the scan first; the join then needs no other exchange.
    kept = keyed.where(some).dropDuplicates([K1, K2]).join(best, [K1, K2], "left_semi")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(~some))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of passages that an earlier document (by id, then place) holds go.

    Null and empty texts, and rows without an id, stay as they are; of texts that share an id each is a document; equal rows stay equal. Extra columns are passed through.
    """
    return substring_dedup.remove_repeated_spans(docs, counts=False)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets; a document stands as often as it is taken.

    Texts without words (null and empty ones) fill no target and are not taken. A null source is one of its own. Equal rows and ids are documents of their own; the mix
    depends on the rows alone, not on their order. Extra columns are passed through.
    """
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, digests of the ids and of what they decode to, and token ids of every row.

    Null and empty texts have no ids. Repeated rows and ids are encoded each. Other columns end here.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

#: No SQL for a trained classifier and a merge loop: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are written to the shared folder; those of a stage are deleted once the next has used them."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            delete(spark, f"{place}/{k - 1}")
    return docs


def summary(docs: DataFrame) -> DataFrame:
    """Rows and tokens of a result of run()."""
    return docs.agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("n_tokens"))
