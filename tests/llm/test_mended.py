"""Faults of earlier rounds."""

import pytest
from corpus_pipeline import near_duplicates
from pyspark.sql import functions as F
from quillstone.llm import classifier, html_text, licenses
from quillstone.llm.token_counts import CHANGE, Rollup


@pytest.mark.parametrize("text", ["all rights reserved", "All Rights Reserved.", "ALL RIGHTS RESERVED"])
def test_wording_that_saves_no_byte_is_found_in_any_case(spark, text):
    templates = {"rights": "All rights reserved"}
    got = licenses.scan_licenses(spark.createDataFrame([(1, "Some words. " + text)], "doc_id long, text string"), templates).collect()
    assert [(r.license, r.missing_words, r.extra_words) for r in got] == [("rights", 0, 0)]
    assert got[0].text.lower().rstrip(".") == "all rights reserved"


def test_a_compacted_rollup_knows_its_batches(spark, tmp_path):
    one = spark.createDataFrame([("insert", "s", None, "t", 5, None)], CHANGE)
    r = Rollup(spark, str(tmp_path / "a"))
    assert r.commit("x", one) and not r.commit("x", one)
    c = r.compact(str(tmp_path / "b"))
    assert not c.commit("x", one) and [tuple(x) for x in c.totals().collect()] == [("s", None, "t", 1, 5)]
    assert c.commit("y", one) and c.compact(str(tmp_path / "c")).batches() == ["compacted", "x", "y"]
    for op in ("remove", None):
        with pytest.raises(Exception, match="unknown op"):
            c.commit("z", spark.createDataFrame([(op, "s", None, "t", 5, None)], CHANGE))
    assert "z" not in c.batches()


ARTICLE = "<html><body><nav>menu</nav><article><h1>T</h1><p>First part.</p>%s<p>Rest one.</p><p>Rest two.</p></article><footer>f</footer></body></html>"


@pytest.mark.parametrize(
    "put, text",
    [
        ("<svg width=\"1\" height='2'/>", ""), ("<math/>", ""), ("<svg><path d='1'/></svg>", ""), ("<button-group><p>in</p></button-group>", "in\n"), ("<title-bar>x</title-bar>", "x\n"), ("<script>var a='<p>';</script>", ""),
        ("<span hidden>gone <span>too</span> still</span>", ""), ('<span style="display:none">gone</span>', ""), ('<p>a <ins class="adsbygoogle">ad</ins> b <i>c</i></p>', "a b c\n"), ("<p>x <b hidden>g</p><p>after</p>", "x\nafter\n"), ("<p>x <b class='k'>g</b> <em>h</em></p>", "x g h\n"),
    ],
)
def test_odd_elements_lose_nothing(put, text):
    assert html_text.main_text(ARTICLE % put) == f"T\nFirst part.\n{text}Rest one.\nRest two."


def test_text_beside_an_article():
    long = " ".join(["long text"] * 20)
    assert html_text.main_text(f"<div id=content>{long}</div><article>Card</article>") == f"{long}\nCard"
    assert html_text.main_text(f"<div>around</div><article>{long}</article>") == long


def test_reruns_agree_where_ids_repeat(spark):
    docs = spark.range(600).select((F.col("id") % 150).alias("doc_id"), F.concat(F.repeat(F.when(F.col("id") % 2 == 0, "good plain words here. ").otherwise("$$ ## junk "), 8), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    labels = spark.range(150).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    scores = [sorted(map(str, classifier.score(docs, classifier.train(d, labels)).collect())) for d in (docs.repartition(3), docs.repartition(7, "text"))]
    assert scores[0] == scores[1]


def test_rows_that_differ_in_a_map_alone(spark):
    schema = "doc_id long, text string, m map<string,int>, n struct<x: map<string,int>>, row_key int, __row_key int"
    rows = [(1, "a b c d e f", {"a": 1}, None, 1, 1), (1, "a b c d e f", {"a": 2}, None, 1, 1), (2, "z", {"a": 1, "b": 2}, None, 1, 1), (2, "z", {"b": 2, "a": 1}, None, 1, 1), (3, None, None, ({"a": 1},), 1, 1)]
    got = near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()
    # Equal texts are copies of each other, whatever their maps: one row stays for each group, and it is one of those given.
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c d e f"), (2, "z"), (3, None)]


def test_every_label_and_unlabelled_document_is_read(spark, monkeypatch):
    """12,000 labels at most were read; now blocks hold all of them, a scarce class in each block."""
    monkeypatch.setattr(classifier, "BLOCK", 50)
    monkeypatch.setattr(classifier, "POOL", 60)
    monkeypatch.setattr(classifier, "LEAST", 10)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.when(F.col("id") % 10 > 0, "good plain words here. ").otherwise("$$ ## junk "), 8), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    labels = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 10 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    rows = classifier.labelled_features(docs, labels).cache()
    sizes = {(r.y, r.held): r["count"] for r in rows.groupBy("y", "held").count().collect()}
    assert sum(n for (y, _), n in sizes.items() if y >= 0) == 600 and sizes[-1, False] == 400
    dealt = classifier.blocks_of(rows, sizes).select("doc_id", "y", "block").collect()
    assert {r.doc_id for r in dealt} == {r.doc_id for r in rows.where("not held").collect()}
    per = {}
    for r in dealt:
        per.setdefault(r.block, []).append(r.y)
    assert len(per) == 12 and all(y.count(0) and y.count(1) and y.count(-1) for y in per.values())
    out = classifier.score(docs, classifier.train(docs, labels)).collect()
    assert sum(x.kept == (x.doc_id % 10 > 0) for x in out) >= 990
