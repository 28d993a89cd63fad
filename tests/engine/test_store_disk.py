import random

from tessera.engine import Engine
from tessera.session import listed, shared_dir

SCHEMA = "document_id string, text string, collection string"
GONE = "tenant string, document_id string"


def rows(spark, n):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(800)]
    return spark.createDataFrame([(f"d{i}", " ".join(r.choices(words, k=400)), f"c{i % 3}") for i in range(n)], SCHEMA)


def files(tmp_path, *tables):
    return {p.relative_to(tmp_path) for t in tables for p in (tmp_path / "store" / t).rglob("*.parquet")}


def consistent(engine, want):
    """Every table, and the stored sums, tell of these documents alone."""
    assert {x.id for x in engine.table("documents").collect()} == want
    assert {x.d for x in engine.table("points").selectExpr("payload.document_id d").collect()} == want
    postings = engine.table("postings")
    assert {x.document_id for x in postings.select("document_id").distinct().collect()} == want
    counted = {(x.collection, x.term): x["count"] for x in postings.groupBy("collection", "term").count().collect()}
    assert {(x.collection, x.term): x.df for x in engine.table("terms").where("df != 0").collect()} == counted
    assert sum(x.total_docs for x in engine.stats("t").collect()) == len(want)
    assert engine.table("stats").selectExpr("sum(chunks)").first()[0] == engine.table("points").count()


def test_a_deletion_marks_documents_and_leaves_files_where_half_of_them_stay(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", dim=4, bucket_bytes=1 << 17)
    docs = rows(spark, 80)
    engine.ingest_rows(docs, "t", "c")
    there, version = files(tmp_path, "points", "postings", "documents"), engine.snapshot().version
    assert len(engine.snapshot().units["documents"]) > 3
    some = {f"d{i}" for i in range(0, 80, 10)}
    engine.delete_all(spark.createDataFrame([("t", d) for d in some] + [("t", "unknown"), ("u", "d1")], GONE))
    left = {f"d{i}" for i in range(80)} - some
    assert files(tmp_path, "points", "postings", "documents") == there  # nothing was written again
    consistent(engine, left)
    assert engine.table("documents", at=engine.snapshot(version)).count() == 80  # a reader of before
    hits = engine.search_sparse(docs.where("document_id in ('d10', 'd11')").selectExpr("document_id as query_id", "text as query"), "t", "c1", 3)
    assert {x.query_id for x in hits.where("rank = 1").collect()} == {"d10", "d11"}
    first = engine.snapshot().version
    engine.delete_all(spark.createDataFrame([("t", "d0"), ("t", "unknown")], GONE))  # none of them is there
    assert engine.snapshot().version == first
    engine.delete("t", "d1")  # more marks beside the first
    left -= {"d1"}
    told = engine.ingest_rows(docs.where("document_id in ('d0', 'd2')"), "t", "c").first()  # one comes back
    assert (told.documents, told.skipped) == (2, 1)
    consistent(engine, left := left | {"d0"})
    engine.clean(older=0)
    engine.purge()
    assert not any(unit.get("marks") for unit in engine.snapshot().units["documents"].values())
    engine.clean(older=0)
    assert not files(tmp_path, "gone")
    consistent(engine, left)


def test_buckets_that_lose_most_documents_are_written_anew(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", dim=4)
    engine.ingest_rows(rows(spark, 30), "t", "c")
    before = engine.snapshot().units["documents"]
    engine.delete_all(spark.createDataFrame([("t", f"d{i}") for i in range(10)], GONE))
    assert {b: u["at"] for b, u in engine.snapshot().units["documents"].items()} == {b: u["at"] for b, u in before.items()}
    engine.delete_all(spark.createDataFrame([("t", f"d{i}") for i in range(10, 20)], GONE))
    after = engine.snapshot().units["documents"]
    assert all(u["at"] != before[b]["at"] and not u.get("marks") for b, u in after.items())
    consistent(engine, {f"d{i}" for i in range(20, 30)})


def test_the_first_documents_are_not_kept_beside_their_store(spark, tmp_path, monkeypatch):
    engine, seen = Engine(spark, f"file://{tmp_path}/store", dim=4, bucket_bytes=1 << 17), []
    persisted = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before, real = persisted(), Engine._add_parts

    def add(self, *a, **k):
        seen.append((persisted() - before, [name for name, _, _ in listed(spark, shared_dir(spark)) if name.startswith("staged-")]))
        return real(self, *a, **k)

    monkeypatch.setattr(Engine, "_add_parts", add)
    told = engine.ingest_rows(rows(spark, 40).unionByName(spark.createDataFrame([("e", "", "c0"), (None, "x", "c0")], SCHEMA)), "t", "c").first()
    assert (told.documents, told.failed, told.chunks) == (41, 1, engine.table("points").count())
    assert seen == [(0, [])]
    assert engine.table("documents").count() == 41
