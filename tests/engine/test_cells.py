import numpy as np
import pytest

from tessera.operators import cells as C
from tessera.operators import retrieval as R


def table(spark, x, first=0):
    return spark.createDataFrame([(str(first + i), [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id string, vector array<float>").repartition(3)


def asked(spark, q):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(q)], "query_id long, vector array<float>")


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_exact_search_equals_the_scan(spark, tmp_path, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 8)).astype(np.float32)
    if kind == "clustered":
        x = (r.normal(size=(12, 8))[r.integers(0, 12, 700)] + 0.05 * x).astype(np.float32)
    if kind == "copies":
        x[100:500] = x[0]  # a hot cell of equal rows: ties go to the key
    points = table(spark, [*x, np.zeros(8)])
    queries = asked(spark, [*x[:9], r.normal(size=8), 100 * x[3], np.zeros(8)])
    index = C.read(spark, C.build(points, f"file://{tmp_path}/i"))
    want = hits(R.dense_topk(queries, points, 6))
    assert hits(C.search(queries, index, points, 6, probes=2, exact=True)) == want and len(want) == 66


def test_recall_and_files_read(spark, tmp_path):
    """Clustered vectors: nearly all of the best found, in a small share of the codes' files."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(150, 16))
    x = (centres[r.integers(0, 150, 6000)] + 0.15 * r.normal(size=(6000, 16))).astype(np.float32)
    points, queries = table(spark, x), asked(spark, x[:40])
    index = C.read(spark, C.build(points, f"file://{tmp_path}/i"))
    want = {(q, key) for q, _, key, _ in hits(R.dense_topk(queries, points, 10))}
    got = {(q, key) for q, _, key, _ in hits(C.search(queries, index, points, 10, probes=8))}
    assert len(got & want) >= 0.95 * len(want) and len(got) == 400
    files = len(index.codes.inputFiles())
    for one in (0, 17):
        query = asked(spark, x[one : one + 1])
        near = query.select("query_id", "vector")
        radius = np.zeros(len(index.centres))
        probed = C.unit_rows(near, "query_id").mapInArrow(C._probes(index.centres, radius, 8), "query_id long, cell long, unit array<double>, most double")
        parts = {r.part for r in index.cells.join(probed.select("cell"), "cell").collect()}
        read = [f for f in index.codes.inputFiles() if int(f.split("part=")[1].split("/")[0]) in parts]
        assert 10 * len(read) <= files


def test_large_cells_are_dealt_out_and_small_tables_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "PIECE_ROWS", 50)
    r = np.random.default_rng(9)
    x = np.concatenate([np.ones((300, 4)) + 0.001 * r.normal(size=(300, 4)), r.normal(size=(40, 4))]).astype(np.float32)
    points, queries = table(spark, x), asked(spark, x[295:305])
    index = C.read(spark, C.build(points, f"file://{tmp_path}/i", count=5))
    assert max(c.pieces for c in index.cells.collect()) >= 4
    assert hits(C.search(queries, index, points, 4, probes=1, exact=True)) == hits(R.dense_topk(queries, points, 4))
    for n in (0, 1, 3):
        few = table(spark, x[:n]) if n else points.limit(0)
        index = C.read(spark, C.build(few, f"file://{tmp_path}/few{n}"))
        assert hits(C.search(queries, index, few, 4, exact=True)) == hits(R.dense_topk(queries, few, 4))
    with pytest.raises(ValueError, match="differ in length"):
        C.build(points.union(spark.createDataFrame([("x", [1.0, 2.0])], points.schema)), f"file://{tmp_path}/odd")


def test_engine_searches_its_cells(spark, tmp_path):
    from tessera.engine import Engine

    engine = Engine(spark, f"file://{tmp_path}/store", dim=8, bucket_bytes=6000)
    rows = lambda docs: spark.createDataFrame(list(docs.items()), "document_id string, text string")
    engine.ingest_rows(rows({f"d{i}": f"Text number {i} of all." for i in range(60)}), "t", "c")
    engine.ingest_rows(rows({"other": "Text number 7 of all."}), "u", "c")
    engine.index_vectors("t", "c", 6)
    q = spark.createDataFrame([(i, f"Text number {i} of all.") for i in (3, 7, 80)], "query_id int, query string")
    found = lambda **k: sorted(tuple(r) for r in engine.search_dense(q, "t", "c", 5, **k).select("query_id", "rank", "chunk_id", "score").collect())
    assert found(probes=6) == found() and len(found()) == 15
    # Changes after the index: what went is not found, what came or changed is, without a new index.
    engine.ingest_rows(rows({"d3": "Another text.", "new": "Text number 80 of all."}), "t", "c")
    engine.delete("t", "d7")
    got = found(probes=6)
    assert got == found() and [r[3] for r in got if r[:2] == (80, 1)] == [1.0] and not [r for r in got if r[0] in (3, 7) and r[3] == 1.0]
    assert engine.search_dense(q, "u", "c", probes=3).count() == 3
    engine.index_vectors("t", "c", 6)
    engine.clean(older=0)
    assert found(probes=6) == got
