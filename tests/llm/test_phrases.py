import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import phrases as P

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pieces_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[\x20\x09]", piece) if w] for piece in re.split("[.,;:!?\x0a-\x0d]", text)]


def brute(rows, least, top, share=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces_of(text):
            n[lang] += len(ws)
            for m in range(1, 6):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, held in f.items():
        candidates = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if (i, j) != (0, len(p)):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        rows = []
        for p, a in candidates.items():
            score, k = min((1000 * a * n[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < share * a:
                rows.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def made(spark, rows, **more):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in P.collocations(docs, **more).collect())


def some_rows(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "été", "Été", "house", "漢字", "x", "\xa0", "a-b", "in", "and", "big"]
    between = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "!?", " ; ", "\x0b", "\r\n"]
    text = lambda: "".join(r.choice(words[: r.choice([4, 13])]) + r.choice(between) for _ in range(r.randint(0, 60)))
    same = "the house of the big house in the house of the big"
    return [(r.choice([text(), text(), same, f"{same}. {text()}"]), r.choice(["en", "en", "en", "fr", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("block, ranges, top", [(1 << 20, 1 << 20, 2000), (700, 40, 2000), (300, 7, 5)])
def test_equals_brute_force(spark, block, ranges, top):
    rows = some_rows(block, 120)
    got = made(spark, rows, least=6, top=top, block_bytes=block, range_windows=ranges)
    assert got == brute(rows, 6, top) and len(got) > 12


def test_share_and_ties(spark):
    rows = [("a b c d. a b", "en")] * 9 + [("b a. d c", "en")] * 9
    assert made(spark, rows, least=3, share=50) == brute(rows, 3, 2000, 50)
    assert made(spark, rows, least=3) == brute(rows, 3, 2000)


def test_nulls_long_texts_and_no_rows(spark):
    rows = [(None, "en"), ("", None), ("...", "en"), ("word", "en"), ("again and again " * 40_000, None), ("one two, " * 300, "en")]
    assert made(spark, rows) == brute(rows, 100, 2000)
    docs = spark.createDataFrame([("x y", "en", "b", 1)], "text string, lang string, block string, f int")
    assert P.collocations(docs).count() == 0 and P.collocations(docs.limit(0)).count() == 0
    assert [r.phrase for r in P.collocations(docs, least=1).collect()] == ["x y"]


def test_scores_beyond_64_bits(spark):
    big = [(3_000_000_000_000_001, 7_000_000_000_000_003, 8_999_999_999_999_999, 90_000_000_000_000_001), (100, 100, 100, 10**17)]
    for a, x, y, n in big:
        words = spark.createDataFrame([(1, "en", "x", x), (2, "en", "y", y)], "id long, lang string, word string, f long")
        phrases = spark.createDataFrame([(bytes([0, 0, 0, 1, 0, 0, 0, 2]), a)], "phrase binary, f long")
        got = P.scored_phrases(phrases, words, spark.createDataFrame([("en", n)], "lang string, n long")).first()
        assert got.score == 1000 * a * n // (x * y)


def test_words_and_windows():
    texts = ["The  cat,sat\ton", "", None, "on", " mat. ", "é.É"]
    words, opens = P.cut_words(pa.array(texts))
    want = [(w, i == 0) for t in texts for piece in pieces_of(t) for i, w in enumerate(piece)]
    assert list(zip(words.to_pylist(), opens.tolist(), strict=True)) == want
    ids = np.array([0, 1, 2, 3, 0, 4, 0, 5, 6, 7, 8, 9, 10], np.uint32)
    assert P.windows(ids).T.tolist() == [[1, 2, 3, 0, 0], [2, 3, 0, 0, 0], [5, 6, 7, 8, 9], [6, 7, 8, 9, 10], [7, 8, 9, 10, 0], [8, 9, 10, 0, 0], [9, 10, 0, 0, 0]]
    keys = np.random.default_rng(1).integers(0, 1 << 18, (5, 2000)).astype(np.uint32) // 60_000 * 60_000
    assert (keys[:, P.radix_order(keys)] == keys[:, np.lexsort(keys[::-1])]).all()


def test_sql_on_the_tables(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = sorted(con.sql(P.SQL).fetchall())
    got = sorted(tuple(r[c] for c in COLUMNS) for r in P.collocations(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    assert got == want and len(got) > 10
