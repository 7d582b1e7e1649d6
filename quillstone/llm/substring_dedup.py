"""Operator 7: removal of repeated passages by sliding sentence spans.

Each text is cut into sentences: after a stop, at a line break, and before a capital that follows a word without one, so that a passage
that was put inside of another sentence begins a sentence of its own. Sentences of over LONG words are cut on after commas and the like and after
words that their own hash picks, which lie alike in every copy. From every sentence on, and up to every sentence, the shortest run of
SEVERAL consecutive sentences or more with at least `min_words` words is a *span*; so a passage of whole sentences that long
is covered by spans inside of it. All spans' hashes (96 bits of the words, white space
left aside) meet in one exchange; a span that occurs earlier, by (doc_id, place), anywhere in the
corpus is repeated, and its sentences go. Of equal spans in one batch only the first goes through the exchange by its hash:
the others are repeated for certain. So a passage that a third of the documents hold sends a row per batch, and
the exchange sorts and streams: no group is held in memory.

`min_words` is less than the length of the passages sought (over 50 words), as these begin and end inside of a sentence
at times: what is left of them between sentences is at least that long.

Defined results. Null text: stays null. Empty text: stays. The first occurrence of a span stays, whole;
in an exact copy all sentences go where it has min_words words, and its text is then empty. Rows that are equal in doc_id and text
are one occurrence: both stay. Rows of one doc_id and other texts are told apart. Null doc_id: the row stays unchanged and takes
no part. What stays of a text is unchanged, white space included. Extra columns are passed through, but for one that is named n_removed where counts are asked for.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_map

#: A sentence ends after a word with a stop (and symbols upon it), or at a line break.
STOP = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][^\w\s]*$")
WORD = re.compile(r"\S+")
#: Words from which on a sentence is cut on; one word in PICK of them ends a part.
LONG, PICK = 16, 8
#: Sentences that a span has at least.
SEVERAL = 2
#: Bytes of text that are worked on at once, and words whose hashes a task keeps.
TEXT_BYTES, KEPT_WORDS = 1_000_000, 60_000
#: Bits of a word: ends in a stop, begins with a capital, ends a part of a long sentence.
STOPS, CAPITAL, PART = 1, 2, 4
#: Odd multipliers of the two span hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
KEY, SPANS, RESULT = "__span_key", "__spans", "__span_result"


class Words(dict):
    """The number of each word that was met; its two hashes and its bits are in lists by number."""

    def __init__(self):
        super().__init__()
        self.first: list[int] = []
        self.second: list[int] = []
        self.bits: list[int] = []

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "replace")
        h = xxhash.xxh3_128_intdigest(raw)
        self.first.append(h & 0xFFFFFFFFFFFFFFFF)
        self.second.append(h >> 64)
        part = word[-1] in ",;:" or zlib.crc32(raw) % PICK == 0
        self.bits.append(STOPS * bool(STOP.search(word)) + CAPITAL * word[0].isupper() + PART * part)
        self[word] = n = len(self.bits) - 1
        return n


def sentence_starts(bits: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """True for words that begin a sentence; breaks: true for words that begin a line or text."""
    starts = breaks.copy()
    if not len(bits):
        return starts
    starts[0] = True
    starts[1:] |= (bits[:-1] & STOPS) > 0
    starts[1:] |= ((bits[1:] & CAPITAL) > 0) & ((bits[:-1] & CAPITAL) == 0)
    at = np.flatnonzero(starts)
    long = np.repeat(np.diff(np.append(at, len(bits))) > LONG, np.diff(np.append(at, len(bits))))
    starts[1:] |= long[1:] & ((bits[:-1] & PART) > 0)
    return starts


def sentences(text: str) -> list[str]:
    """The text in parts, each with the white space that follows it; white space before the first is in it."""
    found = list(WORD.finditer(text))
    words = Words()
    bits = np.array([words.bits[words[m[0]]] for m in found], np.int64)
    breaks = np.array(["\n" in text[a.end() : b.start()] for a, b in zip(found, found[1:], strict=False)], bool)
    at = [found[i].start() for i in np.flatnonzero(sentence_starts(bits, np.append(True, breaks)[: len(found)]))]
    cuts = [0, *at[1:], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if text else []


def spans(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the shortest runs of SEVERAL sentences and min_words words from, and up to, every sentence.

    Sentences of several texts in a row: the words where each begins and ends, and the first and last sentence of its text.
    """
    here = np.arange(len(starts))
    last = np.maximum(np.searchsorted(ends, starts + min_words), here + SEVERAL - 1)
    on = last <= high
    first = np.minimum(np.searchsorted(starts, ends - min_words, side="right") - 1, here - SEVERAL + 1)
    back = first >= low
    # A run that is shortest from both ends counts once.
    back[back] = ~on[first[back]] | (last[first[back]] != here[back])
    return np.concatenate([here[on], first[back]]), np.concatenate([last[on], here[back]])


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse modulo 2^64 for k < n."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1], down[:1] = 1, 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _span_rows(ids: list[int], keys: list[int], texts: list[str], words: Words, min_words: int) -> pa.RecordBatch | None:
    """Rows of texts that are in order of (id, key)."""
    numbers, sizes, breaks = [], [], []
    for text in texts:
        before = len(numbers)
        for line in text.split("\n"):
            some = line.split()
            if some:
                breaks.append(len(numbers))
                numbers += map(words.__getitem__, some)
        sizes.append(len(numbers) - before)
    n = np.array(numbers, np.int64)
    if not len(n):
        return None
    begins = np.zeros(len(n), bool)
    begins[breaks] = True
    at = np.flatnonzero(sentence_starts(np.array(words.bits, np.int64)[n], begins))
    ends = np.append(at[1:], len(n))
    text_end = np.cumsum(sizes)
    owner = np.searchsorted(text_end, at, side="right")
    low = np.searchsorted(at, text_end - sizes)[owner]
    high = (np.searchsorted(at, text_end) - 1)[owner]
    a, b = spans(at, ends, low, high, min_words)
    if not len(a):
        return None
    hashes = []
    for base, given in zip(BASES, (words.first, words.second), strict=True):
        up, down = _powers(len(n) + 1, base)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(given, np.uint64)[n] * up[:-1], dtype=np.uint64)])
        h = (sums[ends[b]] - sums[at[a]]) * down[at[a]]
        hashes.append(((h ^ (h >> np.uint64(32))) * np.uint64(BASES[0])).view(np.int64))
    h1, h2 = hashes[0], (hashes[1] >> 32).astype(np.int32)
    # Only the first of equal spans is in doubt.
    order = np.lexsort((a, owner[a], h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    sure = np.zeros(len(a), bool)
    sure[order[1:]] = same
    key = np.array(keys, np.int64)[owner[a]]
    first, last = (a - low[a]).astype(np.int32), (b - low[a]).astype(np.int32)
    columns = [np.where(sure, key, h1), np.where(sure, 0, h2).astype(np.int32), key, np.array(ids, np.int64)[owner[a]], first, last, sure]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "key", "id", "first", "last", "sure"])


def _hashes(min_words: int):
    """Rows (h1, h2, key, id, first, last, sure): sure rows are repeated for certain and are dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            # Equal rows share the spans that the first of them gives.
            rows = sorted(dict(zip(zip(ids, keys, strict=True), range(len(ids)), strict=True)).items())
            part, size = [], 0
            for k, (who, i) in enumerate(rows):
                text = texts[i].as_py()
                part.append((*who, text.decode("utf-8", "replace")))
                size += len(text)
                if size >= TEXT_BYTES or k == len(rows) - 1:
                    out = _span_rows(*map(list, zip(*part, strict=True)), words, min_words)
                    if out is not None:
                        yield out
                    part, size = [], 0
                    if len(words) > KEPT_WORDS:
                        words = Words()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, id, key, place: (key, first, last) of all but the first occurrence of each hash."""
    top = None  # (h1, h2, key, first) of the first occurrence of the last hash
    for batch in batches:
        h1, h2, key, first, sure = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 6))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (sure[1:] != sure[:-1])
        if top is not None and not sure[0]:
            new[0] = (h1[0], h2[0]) != top[:2]
        at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        head_key = np.where(at >= 0, key[at], top[2] if top else 0)
        head_first = np.where(at >= 0, first[at], top[3] if top else 0)
        keep = sure | (key != head_key) | (first != head_first)
        if not sure[-1]:
            top = (h1[-1], h2[-1], head_key[-1], head_first[-1])
        else:
            top = None
        out = batch.select(["key", "first", "last"]).filter(pa.array(keep))
        if out.num_rows:
            yield out


def _without(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    rows = []
    for t, a, b in zip(text, first, last, strict=True):
        if a is None:
            rows.append((None, 0))
            continue
        parts = sentences(t)
        gone = np.zeros(len(parts) + 1, np.int64)
        np.add.at(gone, np.asarray(a), 1)
        np.add.at(gone, np.asarray(b) + 1, -1)
        gone = np.cumsum(gone)[:-1] > 0
        rows.append(("".join(p for p, g in zip(parts, gone, strict=True) if not g), int(gone.sum())))
    return pd.DataFrame(rows, columns=["text", "n_removed"])


def remove_repeated_spans(docs: DataFrame, min_words: int = 40, counts: bool = True) -> DataFrame:
    """`docs` with repeated spans cut out of `text`; with counts, the column n_removed (sentences) follows."""
    keyed = docs.withColumn(KEY, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    given = keyed.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), KEY, F.col("text").cast("binary"))
    found = arrow_map(given, _hashes(min_words), "h1 long, h2 int, key long, id long, first int, last int, sure boolean")
    dealt = found.repartition("h1", "h2").sortWithinPartitions("sure", "h1", "h2", "id", "key", "first")
    hits = arrow_map(dealt, _repeated, "key long, first int, last int")
    flags = hits.groupBy(F.col("key").alias(KEY)).agg(F.collect_set(F.struct("first", "last")).alias(SPANS))
    joined = keyed.join(flags, KEY, "left")
    # Texts without a repeated span don't go to Python.
    cut = F.pandas_udf(_without, "text string, n_removed long")(F.when(F.col(SPANS).isNotNull(), F.col("text")), F.col(f"{SPANS}.first"), F.col(f"{SPANS}.last"))
    done = joined.withColumn(RESULT, cut)
    text = F.when(F.col(SPANS).isNull(), F.col("text")).otherwise(F.col(f"{RESULT}.text")).alias("text")
    more = [F.coalesce(f"{RESULT}.n_removed", F.lit(0)).alias("n_removed")] if counts else []
    return done.select(*(text if c == "text" else F.col(f"`{c}`") for c in docs.columns if not (counts and c == "n_removed")), *more)
