import random
import re

from tessera.llm import ngram_join as N

DDL = "doc_id long, text string, note string, label string, n long"


def brute(rows):
    def lower(t):
        return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")

    sets = []
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(text))
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    def links(i, a, x):
        return sum(b is not None and i != j and 100 * len(x & y) >= 75 * len(x | y) for j, (b, y) in enumerate(sets)) if a is not None and x else 0

    return sorted((str(d), len(s), str(None if d is None else find(d)), links(i, d, s)) for i, (d, s) in enumerate(sets))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], DDL)
    got = N.jaccard_components(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(r.doc_id), str(r.component_id)) for r in N.jaccard_components(df, links=False).collect())
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got)


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(12))
    rows, texts = [], []
    for i in range(n):
        pick = r.random()
        if texts and pick < 0.55:
            w = r.choice(texts).split(" ")
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
                w[r.randrange(len(w))] = word()
            text = " ".join(w)
        elif pick < 0.7:
            text = f"{passage} " + " ".join(word() for _ in range(r.randint(0, 30)))
        else:
            text = " ".join(word() for _ in range(r.randint(1, 90)))
        texts.append(text)
        rows.append((i, text.upper() if r.random() < 0.2 else text))
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed, 160)
        assert run(spark, rows) == brute(rows)


def test_long_lists_are_split_over_cells(spark, monkeypatch):
    rows = corpus(5, 120) + [(1000 + i, f"same start of every one here w{i} x{i} y{i} z{i}") for i in range(40)]
    monkeypatch.setattr(N, "CELL_ROWS", 4)  # drives the cells through the pickled module state in local workers
    assert run(spark, rows) == brute(rows)


def test_exactly_at_the_threshold(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    at = base[:-12] + [f"v{i}" for i in range(12)]  # 88 shared of 112: above
    rows = [(1, " ".join(base)), (2, " ".join(at)), (3, " ".join(base[:64] + [f"u{i}" for i in range(40)]))]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i % 977} q{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, long), (8, long + " tail"), (9, "a b c d e f"), (9, "p q r s t u v"), (10, "p q r s t u v"), (None, "p q r s t u v"), (11, "\x0bone\x0ctwo")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_rows_that_share_a_doc_id_are_one_node(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    for rows in ([(3, a), (7, b), (10, a), (10, b)], [(3, a), (3, b), (5, a), (7, b), (8, None), (8, b), (9, None), (9, "x")], [(5, a), (4, a), (4, b), (4, "one two"), (6, "one two"), (1, b + " w x y z")]):
        assert run(spark, rows) == brute(rows)


def variants(seed, n, base_words=60, edits=(0, 1, 2, 3, 5, 8)):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(base_words)]
    other = list(base)
    for i in r.sample(range(base_words), 4):
        other[i] = f"o{i}"
    rows = []
    for i in range(n):
        w = list(r.choice((base, base, other)))
        for _ in range(r.choice(edits)):
            k = r.randrange(len(w))
            w[k : k + r.choice((0, 1, 1, 2))] = [f"e{r.randrange(40)}"]
        rows.append((i, " ".join(w)))
    return rows


def test_links_inside_large_clusters(spark, monkeypatch):
    rows = variants(3, 220) + [(1000 + i, t) for i, t in variants(4, 60, 40)] + [(2000 + i, t) for i, t in variants(3, 40, 60, (0, 0, 1))]
    want = brute(rows)
    assert run(spark, rows) == want
    assert max(x[3] for x in want) > 60
    monkeypatch.setattr(N, "BLOCK_COST", 16)  # many blocks and cells
    monkeypatch.setattr(N, "COLUMNS", 7)
    monkeypatch.setattr(N, "SPREAD", 10)  # and texts dealt over salts
    assert run(spark, rows) == want


def test_lists_that_turn_out_long_are_split(spark, monkeypatch):
    rows = corpus(6, 100) + [(1000 + i, f"same start of every one here w{i} x{i} y{i} z{i}") for i in range(40)]
    monkeypatch.setattr(N, "FREQUENT_BOUND", 0)  # no frequency is known before
    monkeypatch.setattr(N, "CELL_ROWS", 4)
    assert run(spark, rows) == brute(rows)


def test_shared_counts():
    r = random.Random(1)
    sets = [N.np.array(sorted(r.sample(range(50), r.randrange(0, 12))), N.np.uint64) for _ in range(40)]
    assert N._shared(sets[:15], sets[15:]).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[15:]] for a in sets[:15]]
