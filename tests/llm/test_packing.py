"""Operator 11: ids against the tokenizers library, bounds and packings against exhaustive search."""

import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillstone.llm import packing as K
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def odd_texts():
    rnd = random.Random(4)
    some = ["don't", "I'LL", "''s", "über", "ÀÉ", "éa", "ﬁx", "KK", "İx", "x9y", "1234", "a.b", "end.", "end?!", "...", "ª", "µm", "日本語", "🙂🙂", "a b", "­", "c\x85d", "<|endoftext|>", "<|startoftext|>", "ẞß", "½", "²", "_", "a_b", "\x00", " z", "w" * 300, "ÿ,", "'", "'d", "x'veY"]
    texts = [" ".join(rnd.choices(some, k=rnd.randrange(1, 12))) for _ in range(150)] + [rnd.choice(" \t\n\x0b\x0c\r").join(rnd.choices(some, k=9)) for _ in range(50)]
    return texts + some + ["", " ", "\n a  b \t", "x" * 20_000, "ab " * 30_000]


def test_ids_are_the_librarys(tokenizer, monkeypatch):
    texts = odd_texts()
    monkeypatch.setattr(K, "WORDS", 60)  # forgets again and again
    e = K.Encoder(PATH)
    for lo in range(0, len(texts), 17):
        part = texts[lo : lo + 17]
        ids, ends = e.encode(pa.array(part))
        at = 0
        for text, z in zip(part, ends.tolist()):
            assert ids[at:z].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
            at = z
        assert at == len(ids)


def fewest(sizes, capacity):
    """Bins by trying all places."""

    @cache
    def go(rest, room):
        if not rest:
            return len(room)
        n, *more = rest
        found = [go(tuple(more), tuple(sorted(room[:i] + (r - n,) + room[i + 1 :]))) for i, r in enumerate(room) if r >= n and r not in room[:i]]
        return min([*found, go(tuple(more), tuple(sorted((*room, capacity - n))))])

    return go(tuple(sorted(sizes, reverse=True)), ())


def test_bounds_and_best_fit():
    rnd = random.Random(5)
    tight = 0
    for _ in range(300):
        capacity = rnd.choice([7, 10, 12, 30])
        sizes = np.array([rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 9))])
        bound, best = K.least_bins(*np.unique(sizes, return_counts=True), capacity), fewest(sizes.tolist(), capacity)
        assert bound <= best
        tight += bound == best
        bins, places, room = K.best_fit(sizes, capacity)
        # best-fit decreasing, one by one
        plain = []
        for n in sorted(sizes.tolist(), reverse=True):
            fit = [r for r in plain if r >= n]
            if fit:
                plain.remove(min(fit))
            plain.append((min(fit) if fit else capacity) - n)
        assert sorted(room.tolist()) == sorted(plain) and len(room) >= best
        for b in range(len(room)):
            own = sorted(zip(places[bins == b], sizes[bins == b]))
            assert [p for p, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist() and sum(n for _, n in own) == capacity - room[b]
    assert tight > 270
    assert K.least_bins(np.array([], int), np.array([], int), 10) == 0


def gapless(rows, capacity):
    """The number of sequences of rows (sequence_id, offset, length)."""
    found = {}
    for r in rows:
        found.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in found.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


@pytest.mark.parametrize("kind", ["any", "halves", "equal", "thirds"])
def test_rounds_reach_the_bound(spark, monkeypatch, kind):
    rnd = random.Random(6)
    n = 6000
    lengths = {"any": [min(4096, int(rnd.expovariate(1 / 600)) + 1) for _ in range(n)], "halves": [rnd.choice([2049, 2047, 1000]) for _ in range(n)], "equal": [1] * n, "thirds": [rnd.choice([1365, 1366, 4096]) for _ in range(n)]}[kind]
    monkeypatch.setattr(K, "GROUP", 500)
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").repartition(16)
    rows = K.pack(df, 4096).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    got, least = gapless(rows, 4096), K.least_bins(*np.unique(lengths, return_counts=True), 4096)
    everything = len(K.best_fit(np.array(lengths), 4096)[2])
    assert least <= got <= max(least + 1, everything + 1, everything * 1.005)


def test_whole_documents(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(K, "SLICE", 300)
    texts = [*odd_texts(), None, None, "same text.", "same text."]
    rows = [(k if k % 40 else None, t, 1, 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long, sequence_id long").repartition(3)
    packed = K.pack(K.pieces(df, PATH, 100, with_ids=True), 100)
    expected = []
    for doc, text, _, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 100)):
            part = ids[start : start + 100]
            expected.append((str(doc), piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    got = packed.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got) == sorted(expected)
    n = gapless(got, 100)
    lengths = [r.length for r in got]
    assert n <= K.least_bins(*np.unique(lengths, return_counts=True), 100) + 2
    whole = {r.sequence_id: r.ids for r in K.sequences(packed).collect()}
    again = {r.sequence_id: 0 for r in got}
    for r in got:
        again[r.sequence_id] += r.length
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert {k: len(v) for k, v in whole.items()} == again


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert K.pack(K.pieces(df, PATH)).collect() == []
    one = K.pack(K.pieces(df.union(spark.createDataFrame([(3, None)], df.schema)), PATH)).collect()
    assert [(r.doc_id, r.length, r.offset) for r in one] == [(3, 1, 0)] and one[0].ids_crc32 == zlib.crc32(b"\1\0\0\0")


def test_full_pieces_stand_alone(spark):
    df = spark.createDataFrame([(k, 64 if k % 2 else 32) for k in range(100)], "doc_id long, length long")
    rows = K.pack(df.withColumn("x", F.lit(1)), 64).collect()
    assert gapless(rows, 64) == 75 and all(r.x == 1 for r in rows)
