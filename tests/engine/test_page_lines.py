import random
import time

from tessera.operators import layout


def plain(spans):
    """A page's lines by looking through all lines for each span."""
    groups = []
    for s in sorted(spans, key=lambda s: (-s[5], s[3])):
        near = next((g for g in groups if abs(s[5] - g[0][5]) < 0.5 * min(s[1], g[0][1])), None)
        groups.append([s]) if near is None else near.append(s)
    out = []
    for g in groups:
        g.sort(key=lambda s: s[3])
        text = g[0][0]
        for before, s in zip(g[:-1], g[1:], strict=True):
            text += (" " if s[3] > before[4] and not before[0].endswith("-") and text else "") + s[0]
        out.append(text)
    return out


def test_lines_of_many_pages(spark):
    r = random.Random(1)
    pages = {p: [(r.choice(["ab", "c-", "D e", "é"]) + str(i), r.choice([5.0, 10.0, 40.0]), r.random() < 0.5, float(x := i * 7 % 1000), x + 3.0, -4.0 * r.randint(0, n)) for i in range(n)] for p, n in enumerate([1, 30, 200, 3])}
    rows = [(p, *s) for p, spans in pages.items() for s in spans]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, text string, font_size double, is_bold boolean, x_position double, x_end double, y_position double")
    got = {}
    for row in layout.lines(df).orderBy("page_id", "line").collect():
        got.setdefault(row.page_id, []).append(row.text)
    assert got == {p: plain(spans) for p, spans in pages.items()}


def test_a_long_page_takes_time_by_its_lines(spark):
    rows = spark.range(120000).selectExpr("7 AS page_id", "concat('w', id) AS text", "10.0D AS font_size", "false AS is_bold", "double(id % 2) AS x_position", "0.5D AS x_end", "-30.0D * (id div 2) AS y_position")
    began = time.time()
    found = layout.lines(rows).agg({"line": "max"}).first()[0]
    assert found == 59999 and time.time() - began < 60  # minutes, if each span looks through all lines
