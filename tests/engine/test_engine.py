import pytest

from tessera.engine import Engine
from tessera.functions.packing import word_tokens
from tessera.operators import embedding as E
from tessera.sources import extract as X


def test_lifecycle(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "alpha.txt").write_text("Alpha keys rotate every month. Traffic is verified after the rotation.")
    (folder / "beta.txt").write_text("Beta services run on a common runtime with safe memory.")
    engine = Engine(spark, f"file://{tmp_path}/store", dim=16)
    n = engine.ingest(str(folder), "t").first()
    assert (n.documents, n.skipped, n.chunks) == (2, 0, 2)
    again = engine.ingest(str(folder), "t").first()
    assert (again.documents, again.skipped, again.chunks) == (2, 2, 0)
    q = spark.createDataFrame([(1, "keys rotation"), (2, "runtime memory")], "query_id int, query string")
    top = {r.query_id: r.document_id for r in engine.search_hybrid(q, "t", "demo", dense_k=1).where("array_contains(sources, 'sparse') and rank <= 2").collect()}
    assert top == {1: "alpha", 2: "beta"}
    assert engine.search_hybrid(q, "other", "demo").count() == 0
    assert {r.answer for r in engine.answer(q, "t", "demo").collect()} == {"Mock answer to: keys rotation", "Mock answer to: runtime memory"}
    talk = spark.createDataFrame([(1, None, "keys rotation"), (2, "absent", "runtime")], "query_id int, conversation_id string, query string")
    first = {r.query_id: r for r in engine.chat(talk, "t", "demo").collect()}
    assert first[1].answer == "Mock answer to: keys rotation" and first[1].citations and first[2].error == "conversation not found" and first[2].answer is None
    more = spark.createDataFrame([(3, first[1].conversation_id, "runtime memory")], talk.schema)
    assert engine.chat(more, "t", "demo").first().conversation_id == first[1].conversation_id
    assert engine.chat(more, "t", "other").first().error == "collection does not match the conversation"
    assert [(r.role, r.content) for r in engine.history("t", 10).orderBy("position").collect()] == [("user", "keys rotation"), ("assistant", "Mock answer to: keys rotation"), ("user", "runtime memory"), ("assistant", "Mock answer to: runtime memory")]
    assert engine.history("other", 10).count() == 0
    assert Engine(spark, f"file://{tmp_path}/store", dim=16).stats("t").first().total_docs == 2
    engine.delete("t", "alpha")
    assert [r.id for r in engine.table("documents").collect()] == ["beta"] and engine.table("points").count() == 1


def test_buckets_text_search_and_ports(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for i in range(9):
        (folder / f"d{i}.txt").write_text(f"Number {i} rotates the keys. " + ("The keys rotate often." if i % 2 else "Nothing else."))
    (folder / "book.pdf").write_bytes(b"First page of keys||Third page")
    pdf = X.Extractors.standard().register("pdf", X.paged(lambda b: (b.decode().split("|"), {"author": "me"}), ocr=lambda b, i: f"scanned page {i}"))
    calls = []

    def provider(texts):
        calls.append(len(texts))
        return [[float(len(t)), 1.0, 2.0] for t in texts]

    engine = Engine(spark, f"file://{tmp_path}/store", dim=3, provider=provider, extractors=pdf, bucket_bytes=500)
    n = engine.ingest(str(folder), "t").first()
    assert (n.documents, n.failed, n.skipped) == (10, 0, 0)
    assert Engine(spark, f"file://{tmp_path}/other", dim=3).failures(str(folder), "t").select("error").first().error.startswith("pdf extraction needs")
    q = spark.createDataFrame([(1, '"keys rotate" -nothing'), (2, "scanned"), (3, "page or nothing")], "query_id int, query string")
    found = {}
    for r in engine.search_text(q, "t", "demo", 20).collect():
        found.setdefault(r.query_id, set()).add(r.document_id)
    assert found == {1: {"d1", "d3", "d5", "d7"}, 2: {"book"}, 3: {"book", "d0", "d2", "d4", "d6", "d8"}}
    assert engine.search_text(q, "other", "demo").count() == 0
    before = engine.snapshot().units["documents"]
    assert len(before) > 1
    (folder / "d1.txt").write_text("Something quite different now.")
    again = engine.ingest(str(folder), "t").first()
    assert (again.documents, again.skipped) == (10, 9)
    after = engine.snapshot().units["documents"]
    assert sum(before[b] != after.get(b) for b in before) == 1  # one bucket was written anew
    assert {r.document_id for r in engine.search_text(q, "t", "demo", 20).where("query_id = 1").collect()} == {"d3", "d5", "d7"}
    sparse = engine.search_sparse(spark.createDataFrame([(1, "different")], "query_id int, query string"), "t", "demo")
    assert sparse.count() == 1
    assert "payload" not in engine.index("t", "demo").postings._jdf.queryExecution().optimizedPlan().toString()  # postings, no texts
    engine.delete("t", "d3")
    assert {r.document_id for r in engine.search_text(q, "t", "demo", 20).where("query_id = 1").collect()} == {"d5", "d7"}
    assert engine.table("documents").count() == 9 and {r.document_id for r in engine.table("postings").select("document_id").distinct().collect()} == {r.id for r in engine.table("documents").collect()}


def test_embedding_port(spark):
    assert E.batches([5, 5, 1, 9], 10, 2) == [range(0, 2), range(2, 4)] and E.batches([], 1, 1) == []
    for bad in ([0], [11]):
        with pytest.raises(ValueError):
            E.batches(bad, 10, 2)
    tries = []

    def flaky(texts):
        tries.append(len(texts))
        if len(tries) < 3:
            raise E.Transient("busy")
        return [[float(len(t))] for t in texts]

    assert E.call(flaky, ["ab", "c"], sleep=lambda s: None) == [[2.0], [1.0]] and tries == [2, 2, 2]
    rows = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(5)], "id int, text string")
    got = E.embedded(rows, lambda texts: [[float(len(t)), 1.0] for t in texts], 2, tokens=word_tokens(), max_tokens=8, max_items=2)
    assert {r.id: r.dense for r in got.collect()} == {i: [5.0 * (i + 1), 1.0] for i in range(5)}


def test_extractors(spark):
    reg = X.Extractors.standard().register("pdf", X.paged(lambda b: (b.decode().split("|"), {"author": "me", "title": ""}), ocr=lambda b, i: f"ocr {i}"))
    with pytest.raises(ValueError):
        reg.register("pdf", X.utf8)
    files = spark.createDataFrame([("a/x.pdf", "pdf", bytearray(b"one||three")), ("a/y.txt", "text", bytearray(b"\xff")), ("a/z.doc", "doc", bytearray(b""))], "path string, file_type string, content binary")
    got = {r.path: r for r in reg.extract(files).collect()}
    assert got["a/x.pdf"].text == "one\focr 1\fthree" and got["a/x.pdf"].native == {"author": "me"}
    assert "UTF-8" in got["a/y.txt"].error and "doc" in got["a/z.doc"].error
    with pytest.raises(ValueError, match="OCR"):
        X.paged(lambda b: (["", " "], {}))(b"", "f")
    assert X.merged_tags({"native": {"pdf": {"author": "x"}}}, {"author": "y", "made": "z"}) == {"native": {"pdf": {"author": "x", "made": "z"}}}
    assert X.merged_tags({"native": 3}, {"a": "b"}) == {"native": 3} and X.merged_tags({}, {}) == {}
