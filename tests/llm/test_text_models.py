import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import html_text as H
from tessera.llm import language_id as L
from tessera.llm import mixing as M
from tessera.llm import ppm as P
from tessera.llm.common import text_bytes


def test_network_prediction():
    r = np.random.default_rng(1)
    net = L.ByteNet(["a", "b"], filters=3)
    x = r.integers(97, 110, (5, 32)).astype(np.uint8)
    slow = []
    for row in x:
        pooled = [max(sum(t[k][row[i + k], f] for k in range(w)) + b[f] for i in range(len(row) - w + 1)) for w, t, b in zip(net.widths, net.tables, net.bias) for f in range(3)]
        z = np.maximum(pooled, 0) @ net.dense + net.out
        p = np.exp(z - z.max())
        slow.append(p / p.sum())
    assert np.allclose(net.probabilities(x), slow, atol=1e-5)


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = L.identify(docs)
    joined = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert joined and np.mean([r.lang == r.lang_pred for r in joined]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in joined)
    odd = spark.createDataFrame([(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "123 !!", None, 1.0), (None, "der und die", "de", 1.0), (4, "é" * 700, "fr", 1.0), (4, "é" * 700, "fr", 1.0)], "doc_id long, text string, lang string, score double")
    rows = {(r.doc_id, r.lang_pred) for r in L.predict(odd, L.train(docs)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= rows
    assert all(r.lang_pred == "und" and r.score == 0 for r in L.identify(odd.where("lang is null")).collect())
    assert L.identify(odd.limit(0)).count() == 0


def test_short_and_long_labelled_texts_are_learned_from(spark):
    short = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the and", "en"), ("der das", "de")] * 40)] + [(900, "7 %", "zz"), (901, None, "zz")], "doc_id long, text string, lang string")
    got = L.identify(short).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 == 0 else "de") for r in got if r.doc_id < 900)
    assert {r.lang_pred for r in got if r.doc_id >= 900} == {"und"}
    # What tells the languages apart stands only at the end of long texts.
    late = spark.createDataFrame([(i, "x" * 5000 + (" abcab" if i % 2 else " qrsqr") * 60, "aa" if i % 2 else "bb") for i in range(60)], "doc_id long, text string, lang string")
    net = L.train(late, epochs=12)
    ends = spark.createDataFrame([(1, " abcab" * 60), (2, " qrsqr" * 60)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.predict(ends, net).collect()} == {1: "aa", 2: "bb"}


def test_sample_counts_documents_not_rows(spark):
    """Thousands of rows of one document count once, every language is learned from, and the bounds hold."""
    from pyspark.sql import functions as F

    fold = spark.range(4000).select(F.col("id").alias("doc_id")).where(~L.held_out(4, 2))
    one = fold.orderBy("doc_id").first().doc_id
    for doc in (one, one + 4_000_000):
        copies = spark.range(4000).select(F.lit(doc).alias("doc_id"), F.concat(F.lit("the words "), (F.col("id") % 3).cast("string")).alias("text"), F.lit("en").alias("lang"))
        others = fold.where(F.col("doc_id") != doc).select("doc_id", F.lit("der Satz").alias("text"), F.lit("de").alias("lang"))
        got = L.training_sample(copies.union(others).where(~L.held_out(4, 2))).collect()
        english = [r for r in got if r.lang == "en"]
        held = spark.createDataFrame([(doc,)], "doc_id long").where(L.held_out(4, 2)).count()
        assert [(r.doc_id, r.text) for r in english] == ([] if held else [(doc, "the words 0")])
        assert len(got) - len(english) == 300 == len({r.doc_id for r in got if r.lang == "de"})
    many = fold.select("doc_id", F.lit("words").alias("text"), F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("lang"))
    assert L.training_sample(many, most=10).count() == many.count()  # one of each language at least
    few = fold.select("doc_id", F.lit("words").alias("text"), (F.col("doc_id") % 2).cast("string").alias("lang"))
    assert L.training_sample(few, most=10).groupBy("lang").count().where("count = 5").count() == 2


def test_training_follows_the_gradient():
    """One step of plain descent, read off Adam's first moment, against finite differences of the weighted loss."""
    r = np.random.default_rng(3)
    x, y, w = r.integers(97, 110, (6, 32)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0]), r.uniform(0.5, 2, 6)
    loss = lambda net: -(w * np.log(net.probabilities(x)[np.arange(6), y].astype(float))).mean()
    net = L.ByteNet(["a", "b"], filters=3)
    before = loss(net)
    slope = {}
    for name, at in (("dense", (1, 0)), ("dense", (7, 1)), ("out", (0,))):
        moved = L.ByteNet(["a", "b"], filters=3)
        getattr(moved, name)[at] += 1e-2
        slope[name, at] = (loss(moved) - before) / 1e-2
    start = {k: getattr(net, k[0])[k[1]].copy() for k in slope}
    net.fit(x, y, epochs=1, rate=1e-3, weights_of=w)
    for k, g in slope.items():  # Adam's first step is the rate against the gradient's sign
        if abs(g) > 1e-3:
            assert np.sign(getattr(net, k[0])[k[1]] - start[k]) == -np.sign(g)
    assert loss(net) < before


def test_windows_cover_every_byte():
    texts = pa.array(["", "x" * 256, "Y" * 600, None])
    rows, text, used = L.cut(*text_bytes(texts))
    assert text.tolist() == [1, 2, 2, 2] and used.tolist() == [256, 256, 256, 88]
    assert rows[3].tolist() == [121] * 88 + [0] * 168


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=x>Site</a></header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy now</div><article><h1>Main &amp; title</h1><p><b>First</b>ly &lt;this&gt;<br>and   that.<p>Second
 one&nbsp;here &eacute;.</p><aside>See also other things</aside><ul><li>item one in the list</li></ul><form><label>Your mail</label><button>Send</button></form><p>Last words of it.</p></article>
<section class="comments"><p>Great post, thank you all very much for it</p></section><footer>&copy; Site and its owners</footer></body></html>"""


def test_main_text():
    assert H.extract(PAGE) == "Main & title Firstly <this> and that. Second one here é. item one in the list Last words of it."
    assert H.extract(None) == H.extract("") == H.extract("<p>") == ""
    cut = PAGE[: PAGE.index("Last words")]
    assert H.extract(cut).startswith("Main & title") and "Buy" not in H.extract(cut)


def test_long_junk_in_the_article_cuts_nothing_off():
    lead, body, close = "Headline here Short lead of it.", "Body text of the article " * 30, "Closing words."
    many = "<p>" + "junk words to be left out " * 60 + "</p>"
    junk = [f'<div class="advert">{many}</div>', f"<form><label>{many}</label></form>", f'<div class="newsletter">{many}</div>', f"<aside>{many * 3}</aside>", f'<section class="comments"><article class="comment">{many}</article><article class="comment">{many}</article></section>']
    for frame in ("article", "main", "div"):
        for block in junk:
            page = f"<html><body><nav><a href=x>Home</a></nav>{junk[0]}<{frame}><h1>Headline here</h1><p>Short lead of it.</p>{block}<p>{body}</p>{block}{junk[0]}<p>{close}</p></{frame}>{block}<footer>{many}</footer></body></html>"
            assert H.extract(page) == " ".join(f"{lead} {body} {close}".split())
    after = f"<body><article><h1>Headline here</h1><p>{body}</p></article><aside>{many}</aside><div>Site words.</div></body>"
    assert H.extract(after) == " ".join(f"Headline here {body}".split())


def test_labelled_pages_come_back():
    model = H.learn(H.labelled_pages())
    good = 0
    for page, labels in H.labelled_pages(60, seed=99):
        words = [w for kind, _, t in H.tokens(page) if kind == "text" for w in t.split()]
        want = " ".join(w for w, keep in zip(words, labels, strict=True) if keep)
        good += H.extract(page, model) == want
    assert good >= 54


def test_best_run_equals_brute_force():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 9, 40):
        for _ in range(60):
            gains = r.integers(-4, 4, n).astype(float).tolist()
            every = [(sum(gains[a:b]), -a, -(b - a), b) for a in range(n) for b in range(a + 1, n + 1)]
            best = max(every, default=(0, 0, 0, 0))
            first, last = H.best_run(gains)
            assert sum(gains[first:last]) == max(0, best[0])
            if best[0] > 0:  # of equal sums the one that ends first
                assert last == min(b for total, _, _, b in every if total == best[0])


def test_elements_that_are_never_closed_hide_nothing():
    body = "Words of the story go on. " * 8
    want = " ".join(f"Title Lead {body} Last words.".split())
    for odd in ('<svg class="icon"/>', '<svg class="icon">', "<canvas>", "<video src=x>", "<svg><title>no</title><path d=x/></svg>", "<svg><svg></svg>no</svg>", "<object>no</object>", "<noscript>no</noscript>", "<template>"):
        assert H.extract(f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Lead {odd}</p><p>{body}</p><p>Last words.</p></article><footer>c</footer></body>") == want, odd
    for odd in ("<script>var a = 1;", "<style>p{}", "<iframe src=x>"):
        assert H.extract(f"<body><article><h1>Title</h1>{odd}<p>Lead</p><p>{body}</p><p>Last words.</p></article><footer>c</footer></body>") == want, odd


def test_names_on_blocks_of_the_article_cut_nothing():
    body = "Words of the story go on and on. " * 10
    for name in ("lead search-tips", "intro banner", "side note", "reader-question", "header"):
        for frame in ("article", "main"):
            page = f'<body><nav><a href=x>Home</a></nav><{frame}><h1>Title</h1><p class="{name}">The lead tells all.</p><p>{body}</p><p class="{name}">An end.</p></{frame}></body>'
            assert H.extract(page) == f"Title The lead tells all. {body.strip()} An end."
    aside = "<aside><p>" + "many words that are not of the story " * 9 + "</p></aside>"
    page = f"<body><article><h1>Title</h1><p>{body}</p>{aside}<p>Short end.</p></article></body>"
    assert H.extract(page) == f"Title {body.strip()} Short end."


def test_structure_alone_tells_menus_and_shops():
    menu = '<div class="c1"><ul>' + "".join(f"<li><a href=x>Place {i}</a></li>" for i in range(6)) + "</ul></div>"
    shop = '<div class="c7"><p>Buy now</p><p>Only today <a href=x>cheap things</a></p><p>Sale</p></div>'
    story = '<div class="c3"><h1>A plain title</h1><p>' + "Words of the story go on and on. " * 6 + "</p><p>Then it ends, as all of them do.</p></div>"
    assert H.extract(f"<body>{menu}{story}{shop}{menu}</body>") == " ".join(("A plain title " + "Words of the story go on and on. " * 6 + "Then it ends, as all of them do.").split())


@pytest.mark.parametrize("unit", ["<!-", "<a '", '<a "', "<", "</", "<script>", "<svg>", "<p <p", "<!--", "&", "<a href=x>", "<style></styl"])
def test_malformed_pages_take_linear_time(unit):
    import time

    def took(n):
        begun = time.perf_counter()
        H.extract("<article><p>word " + unit * n)
        return time.perf_counter() - begun

    took(1000)
    assert took(40_000) < 40 * max(took(4000), 0.005)


def test_pages(spark, sf):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (2, "v", "", 1), (3, "w", "<article><p>" + "word " * 50_000, 1)], "page_id long, url string, html string, n_chars int")
    got = {(r.page_id, r.url): (len(r.text), r.n_chars) for r in H.extract_pages(pages).collect()}
    assert got[(3, "w")] == (249_999, 249_999) and got[(2, None)] == (0, 0) and len(got) == 4
    assert H.extract_pages(pages.limit(0)).count() == 0


def brute_ppm(train, text):
    tree = collections.defaultdict(collections.Counter)
    for t in train:
        z = bytes([P.START] * P.ORDER) + t.encode() + bytes([P.END])
        for i in range(P.ORDER, len(z)):
            for k in range(P.ORDER + 1):
                tree[z[i - k : i]][z[i]] += 1
    z, total = bytes([P.START] * P.ORDER) + text.encode() + bytes([P.END]), 0.0
    for i in range(P.ORDER, len(z)):
        gone = set()
        for k in range(P.ORDER, -1, -1):
            seen = {s: n for s, n in tree[z[i - k : i]].items() if s not in gone} if z[i - k : i] in tree else {}
            if not seen:
                continue
            den = sum(seen.values()) + len(seen)
            if z[i] in seen:
                total += math.log10(seen[z[i]] / den)
                break
            total += math.log10(len(seen) / den)
            gone |= seen.keys()
        else:
            total -= math.log10(256 - len(gone))
    return total


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog sat", None, "", "abracadabra the", "漢字 and more", "zzz", "the mat the cat", "a b  c\n", "quite new words here", "the cat", "x" * 300])]
    rows += [(None, "not learned"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(d, t, 0.5, 1) for d, t in rows], "doc_id long, text string, score double, row int")
    monkeypatch.setattr(P, "FREQUENT", 3)  # most words go the shuffled way
    got = P.score(df).collect()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low)), "\0end"]
    train = [t or "" for d, t in rows if d is not None and not fold(d)]
    count = collections.Counter(w for t in train for w in words(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        want[(d, fold(d), len(w), sum(count[x] > 0 for x in w), n, round(base, 6), round(brute_ppm(train, t or ""), 3))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got) == want
    assert P.score(df.limit(0)).count() == 0


def test_lm_scores_keep_rare_grams(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the cat sat", "", None, "漢字 and more", "qZ7xW0pLk9", "the mat the cat", "漢字漢文", "x" * 60, "thecatqZ7", "fresh ñ", "abracadabra the the the"])]
    df = spark.createDataFrame([*rows, (None, "the qZ8 漢")], "doc_id long, text string")
    train = [t or "" for d, t in rows if not fold(d)]
    want = {d: round(brute_ppm(train, t or ""), 3) for d, t in [*rows, (None, "the qZ8 漢")]}
    for budget in (0, 8):  # nearly all grams and contexts go the shuffled way
        monkeypatch.setattr(P, "FREQUENT_GRAMS", budget)
        monkeypatch.setattr(P, "NODE_ROWS", budget)  # and all of the trie in shuffled joins
        assert {r.doc_id: round(r.score, 3) for r in P.score(df).collect()} == want


def test_lm_scores_do_not_depend_on_the_split(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r.score for r in P.score(docs).collect()}
    monkeypatch.setattr(P, "FREQUENT_GRAMS", 20_000)
    monkeypatch.setattr(P, "NODE_ROWS", 1000)
    part = {r.doc_id: r.score for r in P.score(docs).collect()}
    assert whole.keys() == part.keys() and all(part[i] == pytest.approx(whole[i], rel=1e-6) for i in whole)
    train = [r.text or "" for r in docs.collect() if not fold(r.doc_id)]
    pick = sorted((r for r in docs.collect() if r.text), key=lambda r: len(r.text))[:3]
    assert [part[r.doc_id] for r in pick] == pytest.approx([brute_ppm(train, r.text) for r in pick], abs=1e-3)


def test_adaptive_scores_learn():
    assert P.adaptive_log10("abababababababab") / 17 > P.adaptive_log10("axbyczdwevfugthr") / 17
    assert P.adaptive_log10(None) == pytest.approx(-math.log10(256))


def brute_mix(rows):
    sizes = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    total = collections.Counter()
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes) - sum(3 * total[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * total[s]}
        if not over:
            return sizes, total, target
        capped |= over


def test_mix_of_many_sources(spark):
    rows = [(i, "w " * (1 + i * i % 37), f"s{i * 7919 % 500}" if i % 50 else None) for i in range(1500)]
    got = M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    _, total, target = brute_mix(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert len(target) > 400 and all(abs(taken[s] - target[s]) < 1.0000001 for s in target)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), s) for i, s in enumerate((["a"] * 60 + ["b"] * 6 + [None] * 9 + [""] * 3 + ["z"] * 20))]
    rows += [(7, None, "a"), (None, "one two", "b"), (3, "dup dup", "empty"), (3, "dup dup", "empty"), (500, "", "none")]
    df = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, size int, key int")
    got = M.mix_sources(df).collect()
    sizes, total, target = brute_mix(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert sorted(r.size for r in got) == sorted(sizes)
    assert all(abs(taken[s] - target[s]) < 1.0000001 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, M.mix_sources(df.repartition(3)).collect()))
    assert M.mix_sources(df.limit(0)).count() == 0


def test_structure_tells_where_names_mislead_or_say_nothing():
    sentence = "Words of the story go on and on here."
    para, nav, foot = f"<p>{(sentence + ' ') * 5}</p>", "<nav><ul><li><a href=x>Home</a></li></ul></nav>", "<footer><p>Copyright us</p></footer>"
    story = " ".join([sentence] * 5)
    links = [f"Item number {i} of the list" for i in range(10)]
    listed = "<ul>" + "".join(f"<li><a href=x>{x}</a></li>" for x in links) + "</ul>"
    page = lambda x: H.extract(f"<html><body>{nav}{x}{foot}</body></html>")
    # Articles made of links.
    assert page(f"<article><h1>Ten best things</h1>{listed}</article>") == " ".join(["Ten best things", *links])
    assert page(f"<main><div class=k3><h1>Head</h1>{para}{listed}<p>The very end.</p></div></main>") == " ".join(["Head", story, *links, "The very end."])
    # Names of which only a part hints at junk.
    assert page(f"<main><h1>Head</h1>{para}<section class='social-policy'><h2>Policy</h2><p>Social policy is a matter of state.</p></section></main>") == f"Head {story} Policy Social policy is a matter of state."
    assert page(f"<article><h1>Head</h1>{para}<div class='reply-example'><p>An example of a reply to it.</p></div></article>") == f"Head {story} An example of a reply to it."
    assert page(f"<article><h1>Head</h1>{para}<div class='share-bar'><p>Share this with all your friends.</p></div></article>") == f"Head {story}"
    # Readers' comments without telling names, behind the article, in it, and on a page without one.
    comments = "<div class=c9>" + "".join(f"<div class=k><b>Ann{i}</b><p>I liked this one a lot, thank you for it.</p></div>" for i in range(4)) + "</div>"
    for x in (f"<article><h1>Head</h1>{para}</article>{comments}", f"<article><h1>Head</h1>{para}{comments}</article>", f"<div class=z><h1>Head</h1>{para}</div>{comments}", f"<article><h1>Head</h1>{para}</article><h3>2 Replies</h3><ul><li><p>I liked this a lot, thank you.</p></li><li><p>Me too, as I said before.</p></li></ul>"):
        assert page(x) == f"Head {story}", x
    # Containers that stand for paragraphs, and wrappers, are no comments.
    assert page("<article><h1>Head</h1><div class=p>Para one of it goes on.</div><div class=p>Para two of it goes on.</div><div class=p>The very end.</div></article>") == "Head Para one of it goes on. Para two of it goes on. The very end."
    assert page(f"<main><div class=k><div class=l><h1>Head</h1>{para}<div><p>Short</p></div><div><p>Other short</p></div><p>End.</p></div></div></main>") == f"Head {story} Short Other short End."


def test_unmatched_and_open_tags_take_linear_time():
    import time

    H.default_model()
    took = []
    for n in (2000, 16000):
        pages = ["<article>" + "<div>" * n + "<b>" * n + "</i>" * n + "<div></div>" * n + "word " * 20, "<p>" + "<b>" * n + "<p>" * n + "</section>" * n, "<section>" + "<b>" * n + "<section>" + "</b>" * n]
        begun = time.process_time()
        for page in pages:
            H.extract(page)
        took.append(time.process_time() - begun)
    assert took[1] < 8 * 4 * max(took[0], 0.05)
