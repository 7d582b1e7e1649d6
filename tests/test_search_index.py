"""Stemming, and the stored index under creations, changes and deletions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from quillstone.functions import stemming
from quillstone.operators import lexical_index as L
from quillstone.operators import retrieval
from quillstone.streaming import runtime

PAIRS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll running run runs run generalizations gener oscillators oscil yes ye yelling yell as as""".split()


def test_published_pairs(spark):
    assert stemming.stems_of(PAIRS[::2]) == PAIRS[1::2]
    assert stemming.stems_of(["a" * 70 + "ing", "is", "", "éing", "123s"]) == ["a" * 70 + "ing", "is", "", "éing", "123"]
    got = spark.createDataFrame([(["running", "runs", "run"],), ([],), (None,)], "t array<string>").select(stemming.stem("t").alias("s")).collect()
    assert [r.s for r in got] == [["run"] * 3, [], None]


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, revision long, deleted boolean, content string, title string, repository string")


def state(index):
    """All that a reader sees."""
    hits = [[tuple(r) for r in index.bm25(q).select("chunk_id", F.round("score", 9)).orderBy("chunk_id").collect()] for q in ("run", "word3 runs", "word1_word2")]
    return hits, sorted(tuple(r) for r in index.chunks().collect()), sorted(tuple(r) for r in index.documents().collect()), tuple(index.stats().first())


def text(rnd):
    return " ".join(rnd.choice(["running", "runs", "run", *(f"word{k}" for k in range(6))]) for _ in range(rnd.randrange(1, 500)))


def rebuilt(spark, tmp_path, live, name):
    return L.LexicalIndex.build(docs(spark, [(i, r, False, c, t, "a") for i, (r, c, t) in live.items()]), str(tmp_path / name))


def test_epochs_equal_a_rebuild(spark, tmp_path):
    rnd, live = random.Random(1), {}
    index = L.LexicalIndex.create(spark, str(tmp_path / "kept"))
    for epoch in range(3):
        batch = []
        for i in range(12) if epoch == 0 else rnd.sample(range(16), 5):
            key, revision = f"d{i}", epoch * 10
            if epoch and rnd.random() < 0.3:
                batch.append((key, revision, True, None, None, None))
                live.pop(key, None)
            else:
                c = text(rnd)
                batch.append((key, revision, False, c, f"t{epoch}", "a"))
                batch.append((key, revision - 1, False, "an older word3 of the same batch", "old", "a"))
                live[key] = (revision, c, f"t{epoch}")
        if epoch == 2:  # comes late: an older revision changes nothing
            batch.append(("d0", 1, False, "word1 word2 late", "late", "a") if "d0" not in {b[0] for b in batch} and live.get("d0", (0,))[0] > 1 else ("dz", 1, True, None, None, None))
        assert index.apply(epoch, docs(spark, batch))
        assert not index.apply(epoch, docs(spark, [("dx", 99, False, "run", "x", "a")]))
        assert state(index) == state(rebuilt(spark, tmp_path, live, f"whole{epoch}"))
    before = state(index)
    index._segment(9, docs(spark, [("d1", 99, False, "run run", "x", "a")]).withColumnRenamed("id", "document_id").select("document_id", "revision", "deleted", "content", *(F.lit(None).cast(k).alias(c) for c, k in L.ATTRIBUTES.items())))
    assert state(index) == before  # it failed before its commit
    assert index.compact(10) and index.epochs() == [10] and state(index) == before
    assert not index.apply(1, docs(spark, [("dx", 99, False, "run", "x", "a")])) and not index.compact(10) and state(index) == before
    assert index.apply(11, docs(spark, [("d1", 999, True, None, None, None)]))
    live.pop("d1", None)
    assert state(index) == state(rebuilt(spark, tmp_path, live, "last"))


def test_streams_of_changes(spark, tmp_path):
    rows = [("a", 1, False, "running dogs", "A", "r"), ("b", 1, False, "a dog runs", "B", "r"), ("c", 1, False, "cats", "C", "r")]
    folder, index = str(tmp_path / "in"), L.LexicalIndex.build(docs(spark, rows), str(tmp_path / "index"))
    found = lambda q: [r.chunk_id for r in index.bm25(q).orderBy("chunk_id").collect()]
    assert found("run dog") == ["a#0", "b#0"]

    def drained():
        stream = spark.readStream.schema(docs(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = runtime.reindexed(stream, index, str(tmp_path / "checkpoint")).start()
        q.awaitTermination()

    docs(spark, [("a", 2, True, None, None, None)]).coalesce(1).write.mode("append").parquet(folder)
    drained()
    assert found("run dog") == ["b#0"]
    docs(spark, [("c", 2, False, "dogs run", "C", "r"), ("d", 1, False, "runs, dog!", "D", "r")]).coalesce(1).write.mode("append").parquet(folder)
    drained()
    assert found("run dog") == ["b#0", "c#0", "d#0"] and found("cats") == []
    commits = index.commits()
    drained()  # nothing new
    assert index.commits() == commits


def simple_score(words, terms):
    places = [[i for i, w in enumerate(words) if w == t] for t in terms]
    if not all(places):
        return None
    if len(terms) == 1:
        return sum(0.1 / (i + 1) ** 2 for i in range(len(places[0]))) / 1.64493406685
    rest = 1.0
    for i in range(len(terms)):
        for k in range(i):
            for x in places[i]:
                for y in places[k]:
                    d = abs(x - y)
                    rest *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    return 1 - rest


@pytest.mark.parametrize("query", ["Running", "word1 word2", "run, word3 run word4", "absent word1", "?!"])
def test_simple_rank(spark, tmp_path, query):
    rnd = random.Random(2)
    rows = [(f"d{k}", 1, False, text(rnd), "t", "a") for k in range(20)]
    index = L.LexicalIndex.build(docs(spark, rows), str(tmp_path / "plain"), stemmed=False)
    terms = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    expected = {r.id: s for r in index.chunks().collect() if terms and (s := simple_score(r.content.split(), terms)) is not None}
    got = {r.chunk_id: r.score for r in index.simple(query).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    with pytest.raises(ValueError):
        L.LexicalIndex.create(spark, str(tmp_path / "stems")).simple(query)


def test_search_with_and_without_an_index(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"d{k}", 1, False, text(rnd), f"t{k}", "ab"[k % 2]) for k in range(12)]
    d = docs(spark, rows).select("id", "content", "title", "repository", F.lit("note").alias("category"), F.lit(5).cast("long").alias("updated_at"))
    from quillstone.sources.vault import chunks

    c = chunks(d)
    v = c.select(F.col("id").alias("chunk_id"), F.array(F.length("content").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    edges = spark.createDataFrame([(f"d{k}", f"d{(5 * k + 1) % 12}", "links_to") for k in range(12)] + [("d3", "d3", "links_to")], "src string, dst string, relation string")
    index = L.LexicalIndex.build(d, str(tmp_path / "index"))
    for more in ({}, {"category": "NOTE"}, {"category": "x"}, {"repository": "a"}, {"mode": "fts"}, {"mode": "vector"}, {"level": "l0"}, {"neighbors": True}):
        one, two = (sorted(map(str, retrieval.hybrid(d, c, v, edges, "running word1", [300.0, 1.0], 6, index=i, **more).collect())) for i in (index, None))
        assert one == two and (more == {"category": "x"}) == (not one)
    near = {r.document_id: r.neighbors for r in retrieval.hybrid(d, c, v, edges, "runs", [300.0, 1.0], 8, index=index, neighbors=True).collect()}
    for doc, found in near.items():
        k = int(doc[1:])
        assert found == sorted({f"d{(5 * k + 1) % 12}", *(f"d{j}" for j in range(12) if (5 * j + 1) % 12 == k)} - {doc})


def test_committed_notes_are_projected(spark, tmp_path):
    index = L.LexicalIndex.create(spark, str(tmp_path / "index"))
    texts = {"a.md": "first words", "b.md": "other words"}
    files = lambda paths: paths.join(spark.createDataFrame(list(texts.items()), "path string, content string"), "path")
    handle = runtime.search_projection(index, files)
    log = lambda rows: spark.createDataFrame(rows, "sequence long, event_type string, aggregate_id string, revision long, payload string")
    said = lambda p: '{"path": "%s", "anchors": []}' % p
    first = log([(1, "memory.committed", "a", 1, said("a.md")), (2, "memory.committed", "b", 1, said("b.md")), (3, "graph.changed", "a", 9, "{}")])
    handle(first, 0)
    found = lambda q: [r.chunk_id for r in index.bm25(q).orderBy("chunk_id").collect()]
    assert found("words") == ["a#0", "b#0"]
    with pytest.raises(FileNotFoundError):
        handle(log([(4, "memory.committed", "c", 1, said("c.md"))]), 1)
    texts.update({"c.md": "new words", "a.md": "second text"})
    handle(log([(4, "memory.committed", "c", 1, said("c.md")), (5, "memory.committed", "a", 2, said("a.md")), (6, "memory.deleted", "b", 2, "{}")]), 1)
    handle(first, 0)  # comes again
    assert found("words") == ["c#0"] and found("second") == ["a#0"]


def test_postings_are_not_dealt_and_hold_lengths(spark, tmp_path):
    rows = docs(spark, [("a#7", 0, False, "run zz running", "t", "a"), ("b", 0, False, "...", "t", "a"), ("c", 0, False, " ".join(["word"] * 300), "t", "a")])
    index = L.LexicalIndex.build(rows, str(tmp_path / "plain"))
    chunks = index.chunks().select("id", L.lexical_tokens("content").alias("terms"))
    made = L.postings(chunks)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = [(r.term, r.chunk_id, r.len, r.places) for r in L.postings(chunks.coalesce(1)).collect()]
    assert [g[0] for g in got] == sorted(g[0] for g in got) and {g[1:] for g in map(lambda r: (r[0], r[1], r[2]), got) if not g[0]} == {("a#7#0", 3), ("b#0", 0), ("c#0", 200), ("c#1", 130)}
    assert [g[3] for g in got if g[0] == "run"] == [[0, 2]]
    assert {r.document_id: (r.chunks, r.words) for r in index.documents().collect()} == {"a#7": (1, 3), "b": (1, 0), "c": (2, 330)}
    assert index.stats().first().n == 4 and not (tmp_path / "plain/postings/epoch=0").joinpath("bucket=0").exists()
