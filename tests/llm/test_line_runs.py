import random
from collections import defaultdict

import duckdb
import pytest

from tessera.llm import line_runs as L


def brute(rows):
    """Kept texts by comparing all keys in one dictionary of documents."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    top = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in holders.items() if len(d) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def made(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in L.deduplicate(docs, **more).collect()), key=str)


def some_rows(seed, n):
    r = random.Random(seed)
    pool = [f"a line of the common kind, number {k}" for k in range(12)] + ["é" * 19, "é" * 20, "x" * 19, "x" * 20, "", "  ", "ÉTÉ À LA PLAGE ENCORE UNE FOIS", "été à la plage encore une fois"]
    odd = lambda x: r.choice([x, x.upper() if x.isascii() else x, f"  {x}\t", f"{x}\r", f"\x0b{x}\x0c", f"\xa0{x}"])
    ids = [*range(-3, n - 3)]
    r.shuffle(ids)
    return [(i, "\n".join(odd(r.choice(pool)) if r.random() < 0.6 else f"own line {r.random()} of {i}" for _ in range(r.randint(0, 9)))) for i in ids]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (6, 3)])
def test_equals_brute_force(spark, batches, fanout):
    rows = some_rows(batches, 60)
    assert made(spark, rows, batches=batches, fanout=fanout) == brute(rows)


def test_nulls_repeats_and_hot_lines(spark):
    hot = "this line stands in almost every document"
    rows = [(i, f"{hot}\n{hot}\nown {i}") for i in range(400)] + [(None, hot), (None, hot), (7, None), (7, hot), (500, ""), (501, f"two of them hold this one only\n{hot}"), (502, "two of them hold this one only")]
    got = made(spark, rows)
    assert got == brute(rows)
    assert [r[3] for r in got if r[0] == 501] == [f"two of them hold this one only\n{hot}"] and sum(hot in r[3] for r in got) == 1


def test_rows_of_one_document_count_once(spark):
    line = "held by two documents in three rows"
    rows = [(1, line), (1, line), (2, line)]
    assert made(spark, rows) == brute(rows) == sorted([(1, 1, 0, line), (1, 1, 0, line), (2, 1, 0, line)], key=str)


def test_long_text_no_rows_and_clashing_names(spark):
    long = "\n".join(["the same long line again and again"] * 30_000 + [f"line number {i} of the long text" for i in range(30_000)])
    rows = [(1, long), (2, long), (3, long + "\nmore"), (4, "short")]
    assert made(spark, rows) == brute(rows)
    docs = spark.createDataFrame([(1, "x", b"k", 3, "t")], "doc_id long, text string, key binary, top long, gone string")
    assert [tuple(r) for r in L.deduplicate(docs).collect()] == [(1, 1, 0, "x")]
    assert L.line_digests(docs.limit(0)).count() == 0


def test_runs_are_compacted_and_sorted(spark, tmp_path):
    runs = L.LineRuns(spark, f"file://{tmp_path}/runs", fanout=3)
    for k in range(7):
        own = spark.createDataFrame([(bytes([x]), 1, 100 - k) for x in range(k, k + 4)], L.RUN)
        runs.add(own)
    assert [len(x) for x in runs.levels] == [1, 2]
    got = {r.key[0]: (r.docs, r.top) for r in runs.merged().collect()}
    assert len(got) == 10 and all(top == 100 - max(0, x - 3) for x, (_, top) in got.items())
    assert all(docs == min(3, x + 1, 10 - x) for x, (docs, _) in got.items())  # a key with enough documents takes no more
    for path in runs.levels[1]:
        for part in spark.read.parquet(path).rdd.glom().collect():
            assert [r.key for r in part] == sorted(r.key for r in part)


def test_sql_on_the_tables(spark, sf):
    con = duckdb.connect()
    files = f"{sf}/documents.parquet"
    con.sql(f"create view documents as select * from read_parquet('{files}')")
    want = sorted(con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({L.SQL})").fetchall())
    got = sorted(tuple(r) for r in L.line_digests(spark.read.parquet(files)).collect())
    assert got == want and sum(r[2] for r in got) > 10
