import random

import pytest

from tessera.operators import pruned as P
from tessera.operators import retrieval as R
from tessera.operators import stored


def made(spark, tmp_path, seed, n, size):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(f"k{i:04d}", " ".join(r.choices(words, weights, k=r.randint(0, 60)))) for i in range(n)] + [("none", None)]
    units = spark.createDataFrame(docs, "key string, text string").repartition(3)
    queries = [(i, " ".join(r.choices(words, k=r.randint(1, 6)) + ["w0", "w1", "w2", "w0"][: r.randint(0, 4)])) for i in range(12)] + [(90, ""), (91, "absent"), (92, "w0 w1 w2 w3"), (93, "w250")]
    asked = spark.createDataFrame(queries, "query_id int, query string")
    full = stored.read(spark, stored.write(units, f"file://{tmp_path}/full{seed}", buckets=4))
    return asked, full, P.read(spark, P.write(units, f"file://{tmp_path}/blocks{seed}", buckets=4, size=size), buckets=4)


def hits(df):
    return sorted((r.query_id, r.rank, r.key, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("seed, n, size, k", [(1, 600, 8, 3), (2, 40, 4, 20), (3, 600, 128, 10)])
def test_same_rows_as_scoring_everything(spark, tmp_path, seed, n, size, k):
    asked, full, blocks = made(spark, tmp_path, seed, n, size)
    got = hits(P.topk(asked, blocks, k))
    assert got == hits(R.stored_topk(asked, full, k)) and len(got) > 12


def test_frequent_terms_are_hardly_read(spark, tmp_path):
    asked, full, blocks = made(spark, tmp_path, 4, 2000, 8)
    some = asked.where("query_id < 12")
    told = P.rounds(some, blocks, 3)
    frequent = lambda df, n="n": df.where("term in ('w0', 'w1', 'w2')").agg({n: "sum"}).first()[0] or 0
    whole = frequent(blocks.blocks.join(P.weighted_terms(some, blocks), "term"))
    read = frequent(told.lead) + frequent(told.blocks) + frequent(told.looked_up.dropDuplicates(["query_id", "bucket", "term", "first"]))
    assert whole > 5000 and read < 0.6 * whole
    assert hits(P.topk(some, blocks, 3)) == hits(R.stored_topk(some, full, 3))


def test_a_task_returns_its_best_alone(spark, tmp_path):
    asked, _, blocks = made(spark, tmp_path, 5, 900, 8)
    plan = P.topk(asked, blocks, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan.split("MapInArrow")[0]  # no row for a posting of a query
