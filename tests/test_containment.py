"""Containment joins against all pairs, tags as published, policies' globs, walks."""

import random

import pytest
from pyspark.sql import functions as F
from quillstone.functions.scoring import cosine
from quillstone.functions.text import jaccard
from quillstone.operators import code, containment, graph, hygiene, retrieval


def test_contained_against_all_pairs(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(n)))
    parts, wholes = [word(6) for _ in range(150)] + ["", None], [word(14) for _ in range(150)] + ["", None]
    p, w = spark.createDataFrame([(x,) for x in parts], "part string"), spark.createDataFrame([(x,) for x in wholes], "whole string")
    got = containment.contained(p, w)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    expected = {(a, b) for a in parts for b in wholes if a and b and a in b}
    assert expected and {tuple(r) for r in got.collect()} == expected
    assert containment.contained(p.limit(0), w).collect() == []


@pytest.mark.parametrize("least", [1, 2])
def test_occurrences_against_counting(spark, least):
    rnd = random.Random(2)
    names = ["pkg/f.go", "pkg/f1.go", "f.go", ".go", "a.a.a", "very/long/path/to/some/file_name.test.go", "x.", "no dot", "ü.é", "..", "f.gox"]
    texts = ["".join(rnd.choice([*names, "x", "/", " ", ".", "a.a", "..."]) for _ in range(rnd.randrange(12))) for _ in range(200)] + ["", None]
    got = containment.occurrences_of(spark.createDataFrame(list(enumerate(texts)), "id long, content string"), spark.createDataFrame([(n,) for n in [*names, None]], "pattern string"), least)
    expected = {(i, n, t.count(n)) for i, t in enumerate(texts) for n in names if t and "." in n and t.count(n) >= least}
    assert len(expected) > 100 and {tuple(r) for r in got.collect()} == expected


def test_tags_meet_titles(spark):
    titles = spark.createDataFrame([("Memória", 0), ("001-sqlite-como-banco", 1), ("Busca Híbrida", 2), ("Carregamento Progressive", 3), ("Grafo", 4), (None, 5)], "title string, pos int")
    tags = spark.createDataFrame([(t,) for t in ("memória", "memoria", "MEMORIA", "sqlite", "busca", "progressive-loading", "grafo-de-notas", "unknown", "de", "", None)], "tag string")
    found = hygiene.resolve_tags(tags, titles)
    got = {r.tag: r.title for r in found.collect()}
    assert got == {"memória": "Memória", "memoria": "Memória", "MEMORIA": "Memória", "sqlite": "001-sqlite-como-banco", "busca": "Busca Híbrida", "progressive-loading": "Carregamento Progressive", "grafo-de-notas": "Grafo"} | ({"de": got["de"]} if "de" in got else {})
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_globs_of_policies_are_quoted(spark):
    rules = spark.createDataFrame([(1, "*", "notes (old)/*", "*", "allow"), (2, "*", "(a/*", "*", "review"), (3, "*", "a+b|c/**", "*", "allow"), (4, "*", "[x]{1}^$.md", "*", "allow"), (5, "*", "w\\d/*", "*", "allow")], "idx int, actor string, path string, op string, decision string")
    paths = {"notes (old)/x": "allow", "notes old/x": "deny", "(a/b": "review", "(a/b/c": "deny", "a+b|c/d/e": "allow", "aab/c": "deny", "[x]{1}^$.md": "allow", "x.md": "deny", "w\\d/k": "allow", "w1/k": "deny"}
    req = spark.createDataFrame([(p, "bot", p, "read") for p in paths], "request string, actor string, path string, op string")
    assert {r.request: r.decision for r in hygiene.decide(req, rules).collect()} == paths


def test_walks(spark):
    rnd = random.Random(3)
    edges = spark.createDataFrame(list({(rnd.randrange(9), rnd.randrange(9), rnd.choice("xy")) for _ in range(40)}), "src long, dst long, kind string")
    start = spark.createDataFrame([(1,), (2,)], "id long")
    for direction in ("out", "in"):
        whole = code.walk(edges, start, 4, direction).groupBy("id", "hop", "kind").agg(F.count("*").alias("ways"))
        assert sorted(map(tuple, code.walk_ways(edges, start, 4, direction).collect())) == sorted(map(tuple, whole.collect()))
        assert code.walk(edges, start, 0, direction).collect() == [] == code.walk_ways(edges, start, 0, direction).collect()
    named = graph.impact(spark.createDataFrame([("a", "b", "links_to")], "src string, dst string, relation string"), "b", 0)
    assert named.collect() == [] and named.columns == ["node", "depth", "relation", "via", "severity"]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7, 1.0])
def test_latent_words_against_all_pairs(spark, least):
    rnd = random.Random(4)
    sets = [(f"d{k:02}", "ab"[k % 2], sorted({f"w{min(rnd.randrange(9), rnd.randrange(9))}" for _ in range(rnd.randrange(9))})) for k in range(60)]
    df, edges = spark.createDataFrame(sets, "id string, repository string, item array<string>"), spark.createDataFrame([("d03", "d01"), ("d02", "d04")], "src string, dst string")
    expected = retrieval.latent_pairs(df, df, edges, jaccard, least, 10_000).collect()
    assert expected and retrieval.latent_words(df, df, edges, least, 10_000).collect() == expected
    assert retrieval.latent(df, df.limit(0), df, edges, least, 5).collect() == expected[:5]


@pytest.mark.parametrize("limit", [3, 10_000])
def test_latent_vectors_against_all_pairs(spark, limit, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRED", 16)
    rnd = random.Random(5)
    rows = [(f"d{k % 50}", "ab"[k % 2], [float(rnd.randrange(-2, 3)) for _ in range(2 + (k % 9 == 0))]) for k in range(80)] + [("e", "a", []), ("f", None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id string, repository string, item array<float>")
    first = retrieval.latent_pairs(df, df, spark.createDataFrame([], "src string, dst string"), cosine, 0.3, 9).collect()
    edges = spark.createDataFrame([(r.b, r.a) for r in first], "src string, dst string")  # the first of all are linked: more must be asked for
    want = retrieval.latent_pairs(df, df, edges, cosine, 0.3, limit).collect()
    assert want and retrieval.latent_vectors(df, df, edges, 0.3, limit).collect() == want


def test_latent_words_of_copies_make_no_pairs_of_all(spark, monkeypatch):
    sets = [(f"d{k:03}", "a", ["x", "y"] if k % 2 else ["x", "z"]) for k in range(60)]
    df, edges = spark.createDataFrame(sets, "id string, repository string, item array<string>"), spark.createDataFrame([("d002", "d000"), ("d000", "d004")], "src string, dst string")
    want = retrieval.latent_pairs(df, df, edges, jaccard, 0.5, 5).collect()
    made, first = [], retrieval._first_members
    monkeypatch.setattr(retrieval, "_first_members", lambda pairs, *more: made.append(pairs.count()) or first(pairs, *more))
    assert retrieval.latent_words(df, df, edges, 0.5, 5).collect() == want and max(made) <= 3


def test_occurrences_hold_neither_texts_nor_patterns_nor_marks_in_memory(spark):
    texts = spark.createDataFrame([(1, "a/b.go. a/b.go. x.y"), (1, "a/b.go"), (2, "a/b.go a/c.go a/c.go"), (2, "a/b.go a/b.go a/b.go"), (None, "a/b.go a/b.go"), (3, None)], "id long, content string")
    patterns = spark.createDataFrame([("a/b.go",), ("a/b.go",), ("a/c.go",), ("none",)], "pattern string")
    got = containment.occurrences_of(texts, patterns, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "count(1)" not in plan
    assert sorted(map(tuple, got.collect())) == [(1, "a/b.go", 2), (2, "a/b.go", 3), (2, "a/c.go", 2)]


def test_uncovered_sorts_before_it_makes_texts(spark):
    notes = spark.createDataFrame([("n", "PKG/a.go pkg/a.go", 1), ("m", "pkg/b.go", 1)], "id string, content string, updated_at long")
    changes = spark.createDataFrame([("pkg/a.go", "A", 1, 1), ("Pkg/b.go", "A", 1, 1), ("c.go", "D", 1, 1), ("x/y/d.go", "M", 5, 0), ("x/y/d.go", None, 0, 0), ("e.txt", "M", 9, 9)], "path string, status string, additions long, deletions long")
    got = hygiene.uncovered(notes, changes)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert hygiene.OTHER_ADVICE in plan[: plan.index("Sort ")]
    assert [tuple(r) for r in got.collect()] == [
        ("x/y/d.go", "y", "M", 5, hygiene.OTHER_ADVICE), ("Pkg/b.go", "Pkg", "A", 2, hygiene.ADVICE["A"]), ("c.go", ".", "D", 2, hygiene.ADVICE["D"]), ("x/y/d.go", "y", None, 0, hygiene.OTHER_ADVICE)]
