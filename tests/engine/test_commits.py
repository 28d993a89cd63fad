"""One state over all tables: writers that meet, writers that die, readers that stay, streams that run again."""

import threading

import pytest

from tessera.engine import Engine, TABLES
from tessera.operators import hashed
from tessera.operators import index as I
from tessera.operators.snapshots import Change, Conflict, Snapshot, SnapshotLog
from tessera.session import create
from tessera.streaming import events


def rows(spark, docs):
    return spark.createDataFrame(list(docs.items()), "document_id string, text string")


def made(spark, tmp_path, **more):
    return Engine(spark, f"file://{tmp_path}/store", dim=4, **more)


def state(engine):
    """What the tables hold: documents, chunks by document, and the stored sums against those counted anew."""
    docs = {r.id for r in engine.table("documents").collect()}
    points = {r.d for r in engine.table("points").selectExpr("payload.document_id d").collect()}
    postings = {r.document_id for r in engine.table("postings").collect()}
    assert docs == points == postings
    counted = {(r.collection, r.term): r.df for r in engine.table("postings").groupBy("collection", "term").count().withColumnRenamed("count", "df").collect()}
    assert counted == {(r.collection, r.term): r.df for r in engine.table("terms").groupBy("collection", "term").sum("df").withColumnRenamed("sum(df)", "df").collect() if r.df}
    stats = {(r.tenant, r.collection): (r.total_docs, r.total_tokens) for r in I.corpus_stats(engine.table("documents")).collect()}
    assert stats == {(r.tenant, r.collection): (r.docs, r.tokens) for r in engine.table("stats").collect() if r.docs}
    return docs


def test_log(spark, tmp_path):
    root = f"file://{tmp_path}"
    a, b = SnapshotLog(spark, root), SnapshotLog(spark, root)
    unit = lambda at: {"at": at, "bytes": 1, "has": ["t"]}
    base = a.commit(Snapshot(), Change({"s": [""]}, {"s": {"0": unit("x"), "1": unit("y")}}))
    with pytest.raises(Conflict):  # both start from nothing
        b.commit(Snapshot(), Change({"s": [""]}, {"s": {"00": unit("z")}}))
    assert b.latest() == base
    one = a.commit(base, Change({"s": ["0"]}, {"s": {"00": unit("p"), "01": unit("q")}}))
    two = b.commit(base, Change({"s": ["1"]}, {"s": {"1": unit("r")}}, parts_come={"d": ["d1"]}))  # another unit: goes on
    assert two.version == 3 and set(two.units["s"]) == {"00", "01", "1"} and two.units["s"]["1"]["at"] == "r"
    with pytest.raises(Conflict):
        b.commit(base, Change({"s": ["0"]}, {"s": {"0": unit("late")}}))
    three = a.commit(one, Change(parts_come={"d": ["d2"]}))
    a.commit(three, Change(parts_gone={"d": ["d1", "d2"]}, parts_come={"d": ["d3"]}))
    with pytest.raises(Conflict):
        b.commit(two, Change(parts_gone={"d": ["d1"]}, parts_come={"d": ["d4"]}))
    assert a.latest().parts == {"d": ["d3"]} and a.at(3) == two and SnapshotLog(spark, root).at(2) == one
    a.commit(a.latest(), Change(streams={"s": 0}))
    for k in range(30):
        a.commit(a.latest(), Change({"s": ["1"]}, {"s": {"1": unit(f"v{k}")}}))
    assert SnapshotLog(spark, root).latest() == a.latest() and list(tmp_path.glob("_log/*.state"))
    assert not create(spark, f"{root}/_log/{1:020d}.json", b"{}") and a.at(1) == base
    assert not list(tmp_path.glob("_log/*.new"))


def test_bucket_names(spark):
    units = ["00", "01", "1000", "1001", "101", "11"]
    h = spark.range(3000).select(hashed.key_hash("id").alias("h"))
    got = h.select("h", hashed.bucket_name(h["h"], units).alias("b")).collect()
    for r in got:
        bits = format(r.h % (1 << 64), "064b")
        assert bits.startswith(r.b) and r.b in units
    assert {r.b for r in got} == set(units)
    assert hashed.split("01", 900, 300) == ["0100", "0101", "0110", "0111"] and hashed.split("", 5, 5) == [""]


def test_buckets_grow_with_rows_and_one_document_rewrites_one(spark, tmp_path):
    text = lambda i: " ".join(f"word{(i * 31 + k) % 977}" for k in range(60))
    counts = []
    for n in (40, 400):
        engine = Engine(spark, f"file://{tmp_path}/s{n}", dim=4, bucket_bytes=6000)
        engine.ingest_rows(rows(spark, {f"d{i}": text(i) for i in range(n)}), "t", "c")
        counts.append(len(engine.snapshot().units["documents"]))
    assert 5 * counts[0] <= counts[1] <= 20 * counts[0]
    before = engine.snapshot().units["documents"]
    engine.ingest_rows(rows(spark, {"d7": "a changed text"}), "t", "c")
    after = engine.snapshot().units["documents"]
    assert sum(unit != after.get(b) for b, unit in before.items()) == 1
    # The unchanged test reads the buckets of the documents at hand, not the whole table.
    incoming = rows(spark, {"d7": "a changed text"})
    version = engine.snapshot().version
    told = engine.ingest_rows(incoming, "t", "c").first()
    assert (told.documents, told.skipped, told.chunks) == (1, 1, 0) and engine.snapshot().units["documents"] == after and engine.snapshot().version == version + 1
    assert len(state(engine)) == 400


def test_a_writer_that_dies_leaves_no_trace(spark, tmp_path, monkeypatch):
    engine = made(spark, tmp_path, bucket_bytes=2000)
    engine.ingest_rows(rows(spark, {f"d{i}": f"text number {i} of all" for i in range(12)}), "t", "c")
    want, version = state(engine), engine.snapshot().version

    class Dead(Exception):
        pass

    steps = [(Engine, "_rewrite"), (Engine, "_add_parts"), (SnapshotLog, "commit")]
    for owner, name in steps:
        for late in (False, True):
            if (name, late) == ("commit", True):
                continue  # committed is committed
            real = getattr(owner, name)

            def dies(self, *a, real=real, late=late, **k):
                if late:
                    real(self, *a, **k)
                raise Dead

            for act in (lambda e: e.delete("t", "d3"), lambda e: e.ingest_rows(rows(spark, {"d3": "new", "d50": "more"}), "t", "c")):
                with monkeypatch.context() as m:
                    m.setattr(owner, name, dies)
                    with pytest.raises(Dead):
                        act(made(spark, tmp_path, bucket_bytes=2000))
                fresh = made(spark, tmp_path)
                assert fresh.snapshot().version == version
    assert state(made(spark, tmp_path)) == want
    assert made(spark, tmp_path).clean(older=0) and state(made(spark, tmp_path)) == want  # the dead writers' folders go


def test_two_writers_and_a_reader(spark, tmp_path):
    first, second = made(spark, tmp_path, bucket_bytes=2000), made(spark, tmp_path, bucket_bytes=2000)
    first.ingest_rows(rows(spark, {f"d{i}": f"text number {i}" for i in range(20)}), "t", "c")
    reader = first.snapshot()
    held = first.table("documents", at=reader)
    errors = []

    def write(engine, docs):
        try:
            engine.ingest_rows(rows(spark, docs), "t", "c")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(e, d)) for e, d in ((first, {f"a{i}": "from the first" for i in range(6)}), (second, {f"b{i}": "from the second" for i in range(6)} | {"d1": "changed"}))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert state(second) == {f"d{i}" for i in range(20)} | {f"a{i}" for i in range(6)} | {f"b{i}" for i in range(6)}
    assert held.count() == 20 and first.table("documents", at=first.snapshot(reader.version)).count() == 20  # the state that it began with
    # A stale writer that touches the same bucket is refused and goes on from the new state.
    stale = second.snapshot()
    first.delete("t", "d2")
    with pytest.raises(Conflict):
        second.log.commit(stale, Change({"documents": list(stale.units["documents"])}, {}))
    second.delete("t", "d3")
    assert {"d2", "d3"}.isdisjoint(state(first)) and len(state(first)) == 30
    first.clean(keep=1, older=0)
    assert len(state(second)) == 30
    for name in TABLES:
        kept = {p.name for p in (tmp_path / "store" / name).glob("*")} if (tmp_path / "store" / name).exists() else set()
        assert kept <= first.snapshot().folders()


def test_parts_are_put_together(spark, tmp_path, monkeypatch):
    engine = made(spark, tmp_path)
    monkeypatch.setattr("tessera.engine.MOST_PARTS", 2)
    for i in range(4):
        engine.ingest_rows(rows(spark, {f"d{i}": f"Common word{i}"}), "t", "c")
    assert len(engine.snapshot().parts["terms"]) == 2 and len(state(engine)) == 4
    assert engine.table("terms").where("term = 'common'").first().df == 4


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    engine = made(spark, tmp_path)
    docs = rows(spark, {"a": "one text", "b": "another text"})
    told = engine.ingest_rows(docs, "t", "c", ("feed", 0)).first()
    assert (told.documents, told.chunks) == (2, 2)
    before = engine.snapshot()
    again = engine.ingest_rows(rows(spark, {"a": "not this one"}), "t", "c", ("feed", 0)).first()
    assert tuple(again) == (0, 0, 0, 0) and engine.snapshot() == before
    assert engine.ingest_rows(rows(spark, {"c": "third"}), "t", "c", ("feed", 1)).first().documents == 1


def test_a_stream_of_documents(spark, tmp_path):
    folder = tmp_path / "incoming"
    for k in range(3):
        rows(spark, {f"d{k}{i}": f"batch {k} text {i}" for i in range(4)}).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    engine = made(spark, tmp_path, bucket_bytes=3000)
    stream = events.read_table(spark, f"file://{folder}", files_per_trigger=1)
    # The sink fails after the commit of a batch: Spark runs the batch again, and it changes nothing.
    real, calls = Engine.ingest_rows, []

    def fails_once(self, *a, **k):
        out = real(self, *a, **k)
        calls.append(a[3][1])
        if calls == [0, 1]:
            raise RuntimeError("lost after the commit")
        return out

    Engine.ingest_rows = fails_once
    try:
        q = engine.follow(stream, "t", "c", f"file://{tmp_path}/checkpoint", "feed")
        with pytest.raises(Exception, match="lost after the commit"):
            q.awaitTermination()
        engine.follow(stream, "t", "c", f"file://{tmp_path}/checkpoint", "feed").awaitTermination()
    finally:
        Engine.ingest_rows = real
    assert calls == [0, 1, 1, 2] and engine.snapshot().streams == {"feed": 2}
    assert state(engine) == {f"d{k}{i}" for k in range(3) for i in range(4)}
    totals = engine.stats("t").first()
    assert (totals.total_docs, engine.index("t", "c").total().first().n) == (12, 12)
