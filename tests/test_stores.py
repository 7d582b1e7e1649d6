"""A relational store, an embedding service, and notes written with compensation."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from quillstone.operators import ingest, writer
from quillstone.sources.embeddings import embedded
from quillstone.sources.jdbc import JdbcStore


def test_a_relational_store_is_like_a_parquet_one(spark, tmp_path):
    store = JdbcStore(spark, f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    kind = "id long, title string, score double"
    old = spark.createDataFrame([(k, f"t{k}", k * 1.5) for k in range(100)], kind)
    new = spark.createDataFrame([(5, "five", 5.0), (99, None, None), (200, "new", 2.0)], kind)
    store.create("docs", old)
    store.upsert("docs", new, ["id"])
    rows = store.read("docs", "id", 4)
    assert rows.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, ingest.upsert(old, new, ["id"]).collect()))
    few = rows.where("id > 97 and title is not null").select("title")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(ID,97)" in plan.replace("(id,", "(ID,") and {r.title for r in few.collect()} == {"t98", "new"}
    store.delete("docs", spark.createDataFrame([(5,), (7,), (1000,)], "id long"))
    assert store.read("docs").count() == 99 and store.read("docs").where("id in (5, 7)").count() == 0
    with pytest.raises(ValueError, match="without a key"):
        store.upsert("docs", spark.createDataFrame([(None, "x", 1.0)], kind), ["id"])
    with pytest.raises(Exception):  # noqa: B017  a value that the column can't take: nothing of the batch is there
        store.upsert("docs", spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, title string, score string"), ["id"])
    assert store.read("docs").where("id in (1, 2)").select("title").orderBy("title").collect() == [("t1",), ("t2",)]
    with pytest.raises(ValueError):
        store.read("docs; drop table docs")


@pytest.fixture
def service():
    seen = {"calls": 0, "now": 0, "most": 0}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            with lock:
                seen["calls"] += 1
                seen["now"] += 1
                seen["most"] = max(seen["most"], seen["now"])
                first = seen["calls"] == 1
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            good = not first and not any("poison" in t for t in said["input"])
            body = json.dumps({"embeddings": [[float(len(t)), 1.0] if t != "short" else [1.0] for t in said["input"]]}).encode()
            with lock:
                seen["now"] -= 1
            self.send_response(200 if good else 500)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    from http.server import ThreadingHTTPServer

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_embeddings_in_order_with_failures(spark, service):
    url, seen = service
    texts = ["x" * k for k in range(1, 40)] + ["poison", None, " ", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").coalesce(1)
    got = {r.id: (r.embedding, r.ok) for r in embedded(df, url, "m", 2, batch=1, at_once=3, pause=0.01).collect()}
    for k, t in enumerate(texts):
        good = t is not None and t.strip() and t not in ("poison", "short")
        assert got[k] == (([float(len(t)), 1.0], True) if good else ([0.0, 0.0], False)), t
    assert len(got) == len(texts) and seen["most"] <= 3 and seen["calls"] == 39 + 1 + 3 + 1  # one failed once, one thrice
    assert all(not r.ok for r in embedded(df, "http://127.0.0.1:9/", "m", 2, attempts=1, timeout=1.0).collect())


@pytest.mark.parametrize("fails", [None, "file", "event", "document"])
@pytest.mark.parametrize("before", [None, "old"])
def test_a_failed_write_leaves_all_as_it_was(spark, tmp_path, monkeypatch, fails, before):
    notes, log, docs = writer.Notes(spark, str(tmp_path)), ["e0"], {"a": 1}
    if before:
        notes.put("n/a.md", before)

    def event():
        if fails == "event":
            raise OSError("lost")
        log.append("e1")
        return lambda: log.remove("e1")

    def document():
        if fails == "document":
            raise OSError("lost")
        docs["a"] = 2
        return lambda: docs.update(a=1)

    if fails == "file":
        monkeypatch.setattr(writer.Notes, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    if fails is None:
        writer.committed(notes, "n/a.md", "new", event, document)
        assert (notes.read("n/a.md"), log, docs) == ("new", ["e0", "e1"], {"a": 2})
        return
    with pytest.raises(writer.WriteFailed) as e:
        writer.committed(notes, "n/a.md", "new", event, document)
    assert e.value.step == fails and e.value.left == [] and (notes.read("n/a.md"), log, docs) == (before, ["e0"], {"a": 1})
    assert not [p for p in tmp_path.rglob("*.writing")]


def test_notes_stay_in_their_folder(spark, tmp_path):
    for path in ("../x.md", "/etc/x", "a/../../b"):
        with pytest.raises(ValueError):
            writer.Notes(spark, str(tmp_path)).put(path, "x")
