"""Operators against small inline goldens."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.scoring import time_decay
from quillstone.operators import code, events, graph, hygiene, ingest, retrieval
from quillstone.sources import vault

EDGE = "src string, dst string, relation string, status string, weight double"


def edges(spark, *rows):
    return spark.createDataFrame([(*r[:2], *(r[2:] or ("links_to", "EXTRACTED", 1.0))) for r in rows], EDGE)


def test_rrf(spark):
    lists = spark.createDataFrame([("fts", i + 1, x) for i, x in enumerate("ABC")] + [("vector", i + 1, x) for i, x in enumerate("BDA")], "source string, rank int, item string")
    got = {r.item: r.score for r in retrieval.rrf(lists, 0).collect()}
    assert got == pytest.approx({"A": 1 / 61 + 1 / 63, "B": 1 / 62 + 1 / 61, "C": 1 / 63, "D": 1 / 62})


def test_time_decay(spark):
    now = 1700000000
    rows = spark.createDataFrame([(0,), (now,), (now + 9,), (now - 30 * 86400,), (now - 60 * 86400,)], "updated_at long")
    assert [r.d for r in rows.select(time_decay("updated_at", now).alias("d")).collect()] == pytest.approx([1, 1, 1, 0.85, 0.775])


def test_times_before_1970_decay_if_they_are_known(spark):
    rows = spark.createDataFrame([(0,), (-86400,)], "updated_at long")
    assert [r.d for r in rows.select(time_decay("updated_at", 30 * 86400, unset=False).alias("d")).collect()] == pytest.approx([0.85, 0.7 + 0.3 * 2 ** (-31 / 30)])


def test_pagerank(spark):
    star = graph.pagerank(edges(spark, *((f"L{i}", "C") for i in range(4))))
    got = {r.node: r.rank for r in star.collect()}
    assert sum(got.values()) == pytest.approx(1) and got["C"] > got["L0"] == pytest.approx(got["L3"])
    cycle = {r.node: r.rank for r in graph.pagerank(edges(spark, ("A", "B"), ("B", "C"), ("C", "A"))).collect()}
    assert cycle == pytest.approx(dict.fromkeys("ABC", 1 / 3))


def test_communities(spark):
    clique = lambda x: [(a, b) for a in x for b in x if a < b]
    e = edges(spark, *clique("ABC"), *clique("DEF"), ("C", "D", "tagged_as", "TAG", 0.0))
    found = graph.communities(e)
    assert {r.node: r.community for r in found.collect()} == dict(zip("ABCDEF", [1, 1, 1, 2, 2, 2]))
    assert graph.modularity(e, found.select("node", "community")).first().q > 0.3


def test_path(spark):
    e = edges(spark, ("A", "B"), ("B", "D"), ("A", "D", "tagged_as", "TAG", 0.3))
    assert tuple(graph.shortest_path(e, "A", "D").first()) == (2, 2.0, "A>B>D")
    assert tuple(graph.shortest_path(e, "A", "D", mode="hops").first()) == (1, 1.0, "A>D")
    assert graph.shortest_path(e, "D", "A").count() == 0
    assert graph.shortest_path(e, "D", "A", directed=False).first().hops == 2


def test_impact(spark):
    e = edges(spark, ("C", "T", "implements", "EXTRACTED", 1.0), ("B", "C", "depends_on", "EXTRACTED", 1.0), ("A", "B"), ("T", "A"))
    got = {r.node: (r.depth, r.severity) for r in graph.impact(e, "T", 2).collect()}
    assert got == {"C": (1, "CRITICAL"), "B": (2, "HIGH")}


def test_quantize(spark):
    import numpy as np

    v = np.random.default_rng(0).standard_normal((50, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "chunk_id string, embedding array<float>")
    codes = retrieval.quantize(rows, 64)
    assert all(len(r.data) == 32 for r in codes.collect())
    got = {int(r.chunk_id): 1 - r.distance for r in retrieval.quantized_knn(codes, v[0].tolist(), 50).collect()}
    assert np.mean([abs(got[i] - v[i] @ v[0]) for i in range(50)]) < 0.05
    r = retrieval.rotation(64)
    assert np.allclose(r @ r.T, np.eye(64))


def test_text(spark):
    md = "---\ntitle: My note\ntags: [a, '#b']\n---\nSee [[Other|label]] and [[rel:depends_on:Base#Part^x1]] #tag.\n\n`[[no]]`\n![[pic.png]]"
    r = spark.createDataFrame([(md,)], "x string").select(T.wikilinks("x").alias("w"), T.inline_tags("x").alias("t"), T.frontmatter_value("x", "title").alias("title"), T.frontmatter_list("x", "tags").alias("tags"), T.clean_markdown(F.lit("**b** [l](u) ![i](p) [[t#h]] <i>x</i>")).alias("c"), T.truncate_words(F.lit("one two three four five"), 15).alias("s")).first()
    assert [(w.target, w.relation, w.embed) for w in r.w] == [("Other", "links_to", False), ("Base", "depends_on", False), ("pic.png", "links_to", True)]
    assert (r.w[1].anchor, r.w[1].block) == ("Part^x1".split("^")[0], "x1")
    assert (r.t, r.title, r.tags, r.c) == (["tag"], "My note", ["a", "b"], "b l i t x")
    assert r.s == "one two..."


def test_globs():
    import re

    hit = lambda g, p: bool(re.search(T.glob_regex(g), p))
    assert hit("*.md", "a/b.md") and hit("docs/**", "docs/x/y") and hit("a/**/z.md", "a/z.md") and not hit("a/*.md", "a/b/c.md") and hit("tmp/**", "x/tmp")


def test_hygiene(spark):
    docs = spark.createDataFrame([("a", "a.md", "A"), ("b", "b.md", None), ("c", "c.md", "C")], "id string, path string, title string")
    e = edges(spark, ("a", "b"), ("a", "gone"), ("b", "b"), ("a", "#t", "tagged_as", "TAG", 0.3))
    assert [r.dst for r in hygiene.dead_links(e, docs).collect()] == ["gone"]
    assert [r.id for r in hygiene.orphans(e, docs).collect()] == ["c"]
    assert {(r.src, r.dst) for r in hygiene.fixed(e, docs).collect()} == {("a", "b"), ("a", "#t")}
    tags = spark.createDataFrame([("memoria",), ("busca",), ("zzz",)], "tag string")
    titles = spark.createDataFrame([("Memória", 1), ("Busca Híbrida", 2)], "title string, pos int")
    assert {r.tag: r.title for r in hygiene.resolve_tags(tags, titles).collect()} == {"memoria": "Memória", "busca": "Busca Híbrida"}


def test_events(spark):
    log = spark.createDataFrame([(1, "e1", "a.b", "x", '{"prompt": "p", "k": "v"}'), (2, "e1", "a.b", "x", "no json"), (3, "e2", "a", "", "[1]")], "sequence long, event_id string, event_type string, aggregate_id string, payload string")
    assert [r.sequence for r in events.append(log.limit(0), log).collect()] == [1]
    got = [r.r.payload for r in log.select("sequence", events.redact().alias("r")).orderBy("sequence").collect()]
    assert got == ['{"prompt":"[REDACTED:prompt]","k":"v"}', "no json", "[1]"]


def test_ingest_and_code(spark, tmp_path):
    files = spark.createDataFrame([("n/a.md", "# A\n\nHello [[b]].", 1), ("n/b.md", "Body #a-tag", 2)], "path string, content string, mtime long")
    t = ingest.tables(files)
    assert {(r.src, r.dst) for r in t["edges"].collect()} == {("doc-n-a.md", "b"), ("doc-n-b.md", "a")}  # a tag that holds a title
    f, s = code.ingest(spark.createDataFrame([("x/main.go", "package x\nfunc Run() {\n}\ntype T struct {\n")], "path string, content string"))
    assert {(r.kind, r.name, r.start_line) for r in s.collect()} == {("func", "Run", 2), ("type", "T", 4)}


def test_note_types_and_colors(spark):
    from quillstone.functions.scoring import community_color, note_type, type_color

    rows = spark.createDataFrame([("docs/guide.md", 0), ("reference/y", 1), ("decision-1", 12), ("x/ADR-7", 13), ("my-concept", 2), ("howto/a", 3), ("synthesis", 4), ("compiled", 5), ("plain", -1)], "node string, c int")
    got = rows.select("node", note_type("node").alias("t"), community_color("c").alias("k")).withColumn("k2", type_color("t")).collect()
    assert [r.t for r in got] == ["guide", "reference", "decision", "decision", "concept", "guide", "synthesis", "synthesis", "other"]
    assert [r.k for r in got][:4] == ["#64748b", "#6366f1", "#eab308", "#6366f1"] and got[-1].k == got[-1].k2 == "#64748b"


def test_fixed_lists(spark):
    r = spark.range(1).select(
        T.wikilinks(F.lit("[[supports:X]] [[Y|fixes]] [[contradicts:Z]]")).alias("w"),
        T.is_code_file(F.lit("a/b.PS1")).alias("ps1"), T.is_code_file(F.lit("a.scala")).alias("scala"),
        *(T.detect_language(F.lit(p), F.lit(h)).alias(f"l{i}") for i, (p, h) in enumerate([("a.c", ""), ("a.pyi", ""), ("run", "#!/usr/bin/env python3\nx"), ("run", "#!/bin/sh"), ("run", "#!/usr/bin/node"), ("a.cjs", "")])),
    ).first()
    assert [(w.target, w.relation) for w in r.w] == [("X", "supports"), ("Y", "fixes"), ("contradicts:Z", "links_to")]
    assert r.ps1 and not r.scala and [r[f"l{i}"] for i in range(6)] == ["cpp", "python", "python", "shell", None, "javascript"]
    docs = spark.createDataFrame([(p, p, p) for p in ("docs/adr/1.md", "x/.specs/a.md", "archive/a.md", r"a\\.github\\b.md".replace("\\\\", "\\"))], "id string, path string, title string")
    assert [r.id for r in hygiene.orphans(edges(spark, ("q", "r")), docs).collect()] == ["archive/a.md"]


def test_mentions_and_uncovered(spark):
    notes = spark.createDataFrame([("a", "See ./src/pkg/f1.go, then src/pkg/f1.go.", 1), ("b", "pkg/f1.go once; main.go main.go", 2), ("c", None, 3)], "id string, content string, updated_at long")
    changes = spark.createDataFrame([("pkg/f1.go", "A", 3, 1), ("main.go", "M", 1, 1), ("Lost/f2.go", "D", 9, 9), ("x/notes.md", "A", 1, 1)], "path string, status string, additions long, deletions long")
    assert {(r.id, r.path, r.n) for r in hygiene.mentions(notes, changes).collect()} == {("a", "pkg/f1.go", 2), ("b", "main.go", 2)}
    got = hygiene.uncovered(notes, changes).collect()
    assert [(r.path, r.package, r.churn) for r in got] == [("Lost/f2.go", "Lost", 18)] and got[0].action.startswith("Verificar")
    commits = spark.createDataFrame([(5,), (9,)], "at long")
    found = hygiene.drift(notes, changes, commits)
    assert [(r.id, r.commits_behind) for r in found.collect()] == [("a", 2), ("b", 2)]
    o = hygiene.drift_overall(found).first()
    assert (o.notes, o.critical + o.high + o.medium + o.low) == (2, 2) and o.overall == pytest.approx(sum(r.score for r in found.collect()) / 2, abs=0.051)


def test_chunks_of_long_texts(spark):
    words = [f"w{i}" for i in range(20_000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "a  b"), (3, " "), (4, None)], "k int, x string").select("k", T.chunk_text("x").alias("c"))
    got = {r.k: r.c for r in rows.collect()}
    assert got[1] == [" ".join(words[i : i + 200]) for i in range(0, 19_891, 170)] and got[1][-1].endswith("w19999") and len(got[1]) == 118
    assert got[2] == ["a  b"] and not got[3] and not got[4]


def test_lexical_search(spark, tmp_path):
    docs = spark.createDataFrame([("a", "The snake_case name of a Café"), ("b", "snake and case, of cafes"), ("c", "case snake"), ("d", ""), ("e", "café café")], "id string, content string")
    index, chunks = retrieval.LexicalIndex.build(docs, str(tmp_path / "index")), vault.chunks(docs)
    for q in ("snake_case", "cafe", "snake case", "of café", "zzz", "", "CASE"):
        a = {r.chunk_id: r.score for r in retrieval.bm25(chunks, q).collect()}
        assert a == pytest.approx({r.chunk_id: r.score for r in index.bm25(q).collect()}), q
        some = chunks.where("document_id <> 'e'")
        assert {r.chunk_id: r.score for r in retrieval.bm25(some, q).collect()} == pytest.approx({r.chunk_id: r.score for r in index.bm25(q, within=some.select("document_id")).collect()}), q
    ids = lambda q: {r.chunk_id for r in index.bm25(q).collect()}
    assert ids("snake_case") == {"a#0"} and ids("snake case") == {"a#0", "b#0", "c#0"} and ids("cafe") == {"a#0", "b#0", "e#0"}


def test_vectors_and_fallbacks(spark):
    v = spark.createDataFrame([("x", [1.0, -2.5, 0.0]), ("y", None)], "chunk_id string, embedding array<float>")
    blobs = v.select("chunk_id", retrieval.to_blob().alias("data"))
    assert bytes(blobs.first().data) == b"\x00\x00\x80?\x00\x00 \xc0\x00\x00\x00\x00"
    assert {r.chunk_id: r.e for r in blobs.select("chunk_id", retrieval.from_blob().alias("e")).collect()} == {"x": [1.0, -2.5, 0.0], "y": None}
    chunks = spark.createDataFrame([("x",), ("z",)], "id string")
    assert {r.id: r.embedding for r in retrieval.with_vectors(chunks, v, 3).collect()} == {"x": [1.0, -2.5, 0.0], "z": [0.0] * 3}
    codes = retrieval.quantize(spark.createDataFrame([("q", [1.0, 0.0])], "chunk_id string, embedding array<float>"), 2)
    assert retrieval.knn_or_codes(v.limit(0), codes, [1.0, 0.0], 3).first().chunk_id == "q"
    one = lambda *items: spark.createDataFrame([(i + 1, x) for i, x in enumerate(items)], "rank int, item string")
    broken = lambda: spark.read.parquet("/no/such/store")
    both, note = retrieval.federated_search(lambda: one("a", "b"), lambda: one("b"))
    assert [(r.item, r.origin) for r in both.collect()] == [("b", "[local+central]"), ("a", "[local]")] and note == ""
    only, note = retrieval.federated_search(lambda: one("a"), broken)
    assert [r.item for r in only.collect()] == ["a"] and note == "central unavailable"
    far, note = retrieval.federated_search(broken, lambda: one("c"))
    assert [(r.item, r.origin) for r in far.collect()] == [("c", "[central]")] and note == "local unavailable"
    with pytest.raises(Exception):
        retrieval.federated_search(broken, broken)


def test_graph_outputs(spark):
    e = edges(spark, ("d1", "d2"), ("d2", "d3"), ("d3", "d1"), ("x", "d1", "implements", "INFERRED", 0.6), ("d1", "gone"))
    ranks = graph.pagerank(e)
    seen = {r.node: r for r in graph.view(e, ranks, "d1", graph.communities(e)).collect()}
    top = max(r.rank for r in seen.values())
    assert seen["d1"].radius == round(8 + 20 * seen["d1"].rank / top + 6, 1) and seen["d1"].color == "#f59e0b" and seen["d1"].hub and seen["d1"].community == 1
    assert '"color":"#818cf8"' in graph.view_json(graph.view(e, ranks), e).first().json
    assert [(r.side, r.node) for r in graph.inspect(e, spark.createDataFrame([("d2",), ("d3",)], "node string"), "d1", ranks).collect()] == [("in", "x"), ("in", "d3"), ("out", "d2"), ("out", "gone")]
    docs = spark.createDataFrame([("d1", "One", "Body one", "Short"), ("d2", "", "Body two " * 50, "Brief\ntext"), ("d3", "Three", "Body three " * 500, "T " * 500)], "id string, title string, content string, abstract string")
    assert {r.node: r.name for r in graph.named_degrees(e, docs).collect()}["d2"] == "d2"
    text = graph.bundle(graph.pack(e, docs, "d1", 2, 60), docs, "d1", 2, 60).first().text
    assert text.startswith("# 📦 Pacote de Contexto: One\n") and "Body one" in text and "Brief text" in text and "- `d3`" in text and "Body three" not in text
    assert [r.place for r in graph.pagerank_order(e, ranks, 2).collect()] == [1, 2]
    assert graph.stats(e).first().hubs == 1 and graph.stats(e, ranks).first().hubs >= 1


def test_small_text_functions(spark):
    r = spark.range(1).select(T.camel_or_pascal(F.lit("aB")).alias("a"), T.camel_or_pascal(F.lit("ab")).alias("b"), T.light_wikilinks(F.lit("[[a|b]] `[[c]]` [[a|b]]")).alias("w"), T.repo_id().alias("r"), T.merged(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))).alias("m")).first()
    assert r.a and not r.b and r.w == ["a|b", "c", "a|b"] and len(r.r) == 17 and r.m == ["x", "y", "z"]


def test_streaming_projection(spark, tmp_path):
    from quillstone.streaming import runtime

    rows = spark.createDataFrame([(i, f"e{i % 5}", "doc.saved", f"a{i % 2}", i, "{}") for i in range(10)], "sequence long, event_id string, event_type string, aggregate_id string, revision int, payload string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = runtime.deduplicated(runtime.source(spark, str(tmp_path / "in"), rows.schema))
    q = runtime.deliver(stream, "doc.*", runtime.document_projection(str(tmp_path / "out")), str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = runtime.read_projection(spark, str(tmp_path / "out"))
    assert {r.aggregate_id for r in got.collect()} == {"a0", "a1"}


def test_pagerank_packs_a_hub_in_chunks(spark, monkeypatch):
    """edges travelled one by one; a node's are packed, a hub's in several rows, and the ranks stay."""
    e = edges(spark, *(("H", f"L{i}") for i in range(25)), ("L0", "H"), ("L0", "H"), ("L0", "L1"))
    whole = {r.node: r.rank for r in graph.pagerank(e, 6, tolerance=0).collect()}
    monkeypatch.setattr(graph, "CHUNK", 4)
    cut = {r.node: r.rank for r in graph.pagerank(e, 6, tolerance=0).collect()}
    assert len(whole) == 26 and whole.keys() == cut.keys() and all(abs(whole[k] - cut[k]) < 1e-12 for k in whole)
    assert abs(sum(cut.values()) - 1) < 1e-9 and max(cut, key=cut.get) == "H"
    rank = {n: 1 / 26 for n in whole}
    for _ in range(6):
        rest = 0.15 / 26 + 0.85 * sum(r for n, r in rank.items() if n not in ("H", "L0")) / 26
        new = dict.fromkeys(rank, rest)
        for i in range(25):
            new[f"L{i}"] += 0.85 * rank["H"] / 25
        new["H"] += 0.85 * rank["L0"] * 2 / 3
        new["L1"] += 0.85 * rank["L0"] / 3
        rank = new
    assert all(abs(rank[k] - cut[k]) < 1e-9 for k in rank)


def test_pagerank_steps_over_reached_nodes_only(spark, monkeypatch):
    """with orders most nodes are ends of no edge; these have one rank in common and don't travel."""
    real, kept = graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda df: kept.append(real(df)) or kept[-1])
    e = edges(spark, *((f"L{i}", f"C{i % 3}") for i in range(40)), ("L0", "C1"), ("L0", "C1"), ("C0", "C1"), ("C1", "C0"), ("C1", "C2"))
    got = {r.node: r.rank for r in graph.pagerank(e, 6, tolerance=0).collect()}
    ranked = [df.count() for df in kept if "rank" in df.columns]
    near = {f"L{i}": [f"C{i % 3}"] for i in range(40)} | {"L0": ["C0", "C1", "C1"], "C0": ["C1"], "C1": ["C0", "C2"]}
    rank = dict.fromkeys([*near, "C2"], 1 / 43)
    for _ in range(6):
        new = dict.fromkeys(rank, (0.15 + 0.85 * rank["C2"]) / 43)
        for s, to in near.items():
            for d in to:
                new[d] += 0.85 * rank[s] / len(to)
        rank = new
    assert got == pytest.approx(rank, abs=1e-12)
    assert ranked == [3] * 7
