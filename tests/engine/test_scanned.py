import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import retrieval as R
from tessera.operators import stored


def made(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["ÉTÉ", "ß"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(300)]
    rows = [(f"k{r.random()}", text) for text in texts + ["w1 w2 w2"] * 200] + [("none", None), ("empty", "")]  # equal scores go by key
    r.shuffle(rows)
    asked = [(i, " ".join(r.choices(words, k=r.randint(1, 8)))) for i in range(20)] + [(90, ""), (91, "absent"), (92, "W1 w2"), (93, None)]
    return spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(rows, "key string, text string").repartition(5)


def hits(df):
    return sorted((r.query_id, r.rank, r.key, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("cells, pairs, least", [(1 << 19, 1 << 21, 1 << 18), (50, 7, 20)])
def test_scan_and_index_give_the_rows_of_the_join(spark, tmp_path, monkeypatch, cells, pairs, least):
    monkeypatch.setattr(R, "SUM_CELLS", cells)
    monkeypatch.setattr(R, "SUM_PAIRS", pairs)
    monkeypatch.setattr(R.whole_units, "__defaults__", (least,))
    asked, units = made(spark, 1)
    plain = hits(R.sparse_topk(asked, I.postings(units, "key"), units.agg(F.count(F.lit(1)).alias("n")), 7, "key"))
    assert len(plain) > 100
    assert hits(R.scanned_topk(asked, units, f"file://{tmp_path}/counts{cells}", 7)) == plain
    index = stored.read(spark, stored.write(units, f"file://{tmp_path}/index{cells}", buckets=3))
    assert hits(R.stored_topk(asked, index, 7)) == plain
    monkeypatch.setattr(R, "SMALL_ROWS", 10)  # more weights than go to all tasks
    assert hits(R.scanned_topk(asked, units, f"file://{tmp_path}/many{cells}", 7)) == plain == hits(R.stored_topk(asked, index, 7))


def test_a_task_returns_its_best_alone(spark, tmp_path):
    asked, units = made(spark, 2)
    found = R.scanned_topk(asked, units.repartition(3), f"file://{tmp_path}/counts", 2)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "Generate" not in text  # no pair of posting and query becomes a row
