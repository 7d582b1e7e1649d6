"""Operator 13 against all pairs, with many small lists and blocks too."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillstone.llm import hard_negatives as H

COLUMNS = "vec_id long, label int, embedding array<float>"
LONG = (1 << 63) - 1


def vectors(n, seed, dim=8, groups=6):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(k, rnd.randrange(4), [m + rnd.gauss(0, 0.2) for m in middle[rnd.randrange(groups)]]) for k in range(n)]


def expected(rows, every):
    held = {}
    for key, label, v in rows:
        if key is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * x) for x in v]
        held[key] = min(held.get(key, (label, x)), (label, x))
    dim = max((len(x) for _, x in held.values()), default=0)
    out = []
    for a, (label, x) in held.items():
        if a % every:
            continue
        def score(y):
            return max(min(sum(p * q for p, q in zip(x, y)), LONG), -LONG)  # the shorter one ends in zeros

        order = sorted((-score(y), b, other) for b, (other, y) in held.items() if b != a)
        for fall, b, _ in [r for r in order if r[2] == label][:5]:
            good = [r for r in order if r[2] != label and 50 * -fall <= 100 * -r[0] <= 95 * -fall][:3]
            out += [(a, b, k + 1, r[1], -fall, -r[0]) for k, r in enumerate(good)]
    return sorted(out), dim


def mined(rows, every):
    got = H.mine(H.whole_vectors(rows, "vec_id", F.col("label"), "embedding"), F.col("id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def floats(spark, rows):
    """rows, with the numbers as 32-bit floats hold them."""
    df = spark.createDataFrame(rows, COLUMNS)
    return df, [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(H, "LIST", 12)
        monkeypatch.setattr(H, "BLOCK", 10)
        monkeypatch.setattr(H, "TOGETHER", 7)
        monkeypatch.setattr(H, "FIRST", 2)
        monkeypatch.setattr(H, "FLUSH", 20)
    df, rows = floats(spark, vectors(400, 1))
    found = expected(rows, 10)[0]
    assert len(found) > 200 and mined(df.repartition(3), 10) == found


def test_one_vector_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "LIST", 12)
    rows = vectors(120, 2)
    rows += [(k, k % 3, rows[5][2]) for k in range(120, 900)]
    df, rows = floats(spark, rows)
    assert mined(df, 30) == expected(rows, 30)[0]


def test_odd_rows(spark):
    rnd = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 3) + vectors(10, 3) + [(k, 1, [rnd.gauss(0, 1) for _ in range(rnd.randrange(9))]) for k in range(60, 80)]
    rows += [(80, None, [1.0]), (None, 1, [1.0]), (81, 1, None), (82, 1, [1.0, None]), (83, 1, [nan]), (85, 1, [inf]), (90, 2, []), (95, 2, [0.0, -0.0])]
    rows += [(5, 0, [9.0] * 8), (5, 0, [9.0] * 8), (100, 0, [3e30, 1.0]), (101, 0, [1e30]), (102, 1, [2e30]), (103, 1, [1.1e30, -2.0]), (105, 2, [1e12, 1e12]), (106, 2, [1e12, 1e12]), (107, 3, [8e11, 8e11])]
    df, rows = floats(spark, rows)
    df = df.selectExpr("*", "1 as id", "2 as x", "3 as q")
    assert mined(df, 5) == expected(rows, 5)[0]


def test_no_rows_and_no_anchors(spark):
    df, _ = floats(spark, vectors(20, 4))
    assert mined(df.limit(0), 1) == [] and mined(df.where("vec_id > 0"), 50) == []


def test_bounds_hold_and_skip(spark):
    rows = H.whole_vectors(spark.createDataFrame(vectors(3000, 5, dim=4), COLUMNS), "vec_id", F.col("label"), "embedding")
    lists = H.Lists.build(rows, 8 * H.LIST, 4)
    x, scores = np.array([r.x for r in rows.limit(50).collect()]), []
    up, low = lists.bounds(x)
    for b in lists.blocks.collect():
        s = x @ np.frombuffer(b.xs).reshape(-1, 4).T
        scores.append(s)
        assert (s.max(1) <= up[:, b.list]).all() and (s.min(1) >= low[:, b.list]).all()
    kth = np.sort(np.concatenate(scores, axis=1), axis=1)[:, -6]
    assert (up < kth[:, None]).mean() > 0.3  # lists that end a search, unread
