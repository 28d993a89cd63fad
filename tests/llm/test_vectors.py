import math
from fractions import Fraction

import numpy as np

from tessera.llm import bit_topk as B
from tessera.llm import polytope as X

DDL = "vec_id long, embedding array<float>, label int, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in rows], DDL)


def sample(n=1200, d=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[50:90] = x[50]  # a group of equal vectors
    x[200:260] = x[200] + r.normal(scale=0.01, size=(60, d)).astype(np.float32)
    return x


ODD = [(5000, None), (5100, []), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [float("inf")] * 16), (5500, [1.0, 2.0]), (5600, [2.0, 1.0]), (None, [1.0] * 16)]


def test_exact_topk_equals_brute_force(spark):
    x = sample()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD
    got = [tuple(r) for r in B.top_k(frame(spark, rows)).select("query_id", "rank", "vec_id", "score").collect()]
    q = np.floor(1024 * x.astype(float)).astype(np.int64)
    want = []
    for i in range(0, len(x), 100):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:10]
        want += [(i, r, int(j), int(s[j])) for r, j in enumerate(order, 1)]
    want += [(5500, 1, 5600, 4 * 1024 * 1024), (5600, 1, 5500, 4 * 1024 * 1024)]
    assert sorted(got) == sorted(want)


def test_blocks_with_repeated_ids_and_extremes():
    r = np.random.default_rng(3)
    for d, scale, n in ((1, 5, 70), (3, 2000, 500), (8, 1, 130), (5, 100_000, 64)):
        x = r.integers(-scale, scale + 1, (n, d))
        ids = r.integers(0, n // 2, n)
        pick = np.arange(0, n, 7)
        found = B.top_of_block(ids, x, ids[pick], x[pick], 4)
        for i, (a, s) in zip(pick, found, strict=True):
            score = x @ x[i]
            keep = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:4]
            assert s.tolist() == score[keep].tolist()
            assert a.tolist() == ids[keep].tolist()


def test_large_components_are_exact(spark):
    rows = [(0, [1.0, -2.0]), (100, [1e30, 1.0]), (200, [-1e308, 3.0]), (300, [5e5, 2.0]), (1, [2.5, 0.5]), (2, [1e25, -1e25])]
    got = [tuple(r) for r in B.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("query_id", "rank", "vec_id", "score").collect()]
    value = {i: [math.floor(Fraction(c) * 1024) for c in v] for i, v in rows}
    want = []
    for i in (0, 100, 200, 300):
        s = {j: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(value[i], value[j])))) for j in value if j != i}
        want += [(i, r, j, s[j]) for r, j in enumerate(sorted(s, key=lambda j: (-s[j], j)), 1)]
    assert sorted(got) == sorted(want)


def test_fewer_candidates_and_no_rows(spark):
    two = frame(spark, [(0, [1.0, 2.0]), (100, [1.0, 0.0])])
    assert sorted(map(tuple, B.top_k(two).select("query_id", "rank", "vec_id", "score").collect())) == [(0, 1, 100, 1 << 20), (100, 1, 0, 1 << 20)]
    assert B.top_k(two.limit(0)).count() == 0
    assert [tuple(r) for r in X.search(two).select("query_id", "vec_id", "score").orderBy("query_id").collect()] == [(0, 100, 2.0), (100, 0, 2.0)]
    assert X.search(two.limit(0)).count() == 0


def test_few_or_outlying_rows_are_all_met(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(8, 64)).astype(np.float32)
    ids = [0, 100, 200, 300, 400, 500, 600, 700]
    got = sorted((q, v) for q, v in X.search(frame(spark, [(i, v.tolist()) for i, v in zip(ids, x)])).select("query_id", "vec_id").collect())
    assert got == [(a, b) for a in ids for b in ids if a != b]
    centres = r.normal(size=(2, 64))
    x = (centres[np.arange(300) % 2] + r.normal(scale=0.001, size=(300, 64))).tolist()
    near = r.normal(size=(40, 64)).tolist()  # queries outside the clusters
    rows = [(1 + i + i // 99, v) for i, v in enumerate(x)] + [(1000 + 100 * i, v) for i, v in enumerate(near)]
    count = X.search(frame(spark, rows)).groupBy("query_id").count().collect()
    assert {c["query_id"]: c["count"] for c in count if c["query_id"] >= 1000} == {1000 + 100 * i: 10 for i in range(40)}
    same = [(0, near[0])] + [(1, near[0])] * 30 + [(i, v) for i, v in enumerate(near[1:12], 2)]  # an id of many rows counts once
    assert X.search(frame(spark, same)).select("vec_id").distinct().count() == X.search(frame(spark, same)).count() == 10
    assert X.search(frame(spark, same), tables=2, hashes=1, probes=3).count() == 10


def test_squares_beyond_doubles(spark):
    r = np.random.default_rng(7)
    rows = [(i, (v * 1e200).tolist()) for i, v in enumerate(r.normal(size=(40, 4)))] + [(100 + i, v.tolist()) for i, v in enumerate(r.normal(size=(3, 4)))]
    got = X.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    far = [(x.vec_id, x.score) for x in got if x.query_id == 0]
    assert len(far) == 10 and all(s == math.inf for _, s in far) and far == sorted(far)
    assert sum(x.query_id == 100 for x in got) == 10


def test_neighbours_recall_and_measure(spark):
    x = sample(3000, 64, 5)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7000, [0.0] * 64), (7100, None), (7200, [float("nan")] * 64)]
    got = {}
    for r in X.search(frame(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for i in range(0, len(x), 100):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
        d[i] = np.inf
        best = set(np.lexsort((np.arange(len(x)), d))[:10].tolist())
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hit, total = hit + len(best & {v for _, v, _ in mine}), total + 10
    assert set(got) == set(range(0, len(x), 100))
    assert hit / total >= 0.9


def test_hadamard_keeps_lengths_and_probes_start_with_the_code():
    x = np.random.default_rng(0).normal(size=(50, 40))
    assert np.allclose(np.linalg.norm(X.hadamard(np.pad(x, ((0, 0), (0, 24)))), axis=1), np.linalg.norm(x, axis=1))
    unit = X.units(x)
    for hashes in (1, 2, 3):
        near = X.projections(unit, 1, hashes)
        p = X.probed(near, 40)
        assert (p[:, 0] == X.codes(unit, 1, hashes)).all()
        assert all(len(set(row)) == len(row) for row in p.tolist())
        if hashes == 2:  # the largest sums of all
            every = (near[0][:, :, None] + near[1][:, None, :]).reshape(50, -1)
            assert np.allclose(np.sort(every, axis=1)[:, ::-1][:, :40], np.take_along_axis(every, p, 1))


def test_few_rows_are_visited():
    r = np.random.default_rng(6)
    x = r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables = X.Tables(np.arange(len(x)), x)
    hit, visits = 0, 0
    for i, rows in enumerate(tables.candidates(x[:40], X.to_visit(len(x)))):
        d = ((x - x[i]) ** 2).sum(axis=1)
        hit += np.isin(np.argsort(d, kind="stable")[1:11], rows).sum()
        visits += len(rows)
    assert hit >= 0.9 * 400 and visits < 0.15 * 40 * len(x)


def test_hot_code_is_spread_over_blocks(spark, monkeypatch):
    x = sample(300, 16, 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[100].tolist()) for i in range(400)]
    monkeypatch.setattr(X, "ROW_BLOCK", 64)
    got = X.search(frame(spark, rows)).where("query_id = 100").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1000 + i, 0.0) for i in range(10)]
