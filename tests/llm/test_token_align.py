import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import token_align
from tessera.llm.queries import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def spelt(text):
    """Both libraries' ids and token bytes, token by token; None where they do not spell the text."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(spelt, "a"):
        spelt.a, spelt.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        spelt.a.encode_special_tokens = True
    if not text:
        return None
    alphabet = token_align.byte_alphabet()
    a, b = spelt.a.encode(" " + text, add_special_tokens=False), spelt.b.encode(text)
    raw_a = [bytes(alphabet[c] for c in t) for t in a.tokens]
    pieces = [spelt.b.id_to_piece(i) for i in b]
    raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    return (a.ids, raw_a, b, raw_b) if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode() else None


def brute(texts):
    """Groups by walking both token lists, links by comparing all byte ranges of a group."""
    docs, holders = [], Counter()
    for text in texts:
        got = spelt(text)
        groups, links = [], []
        if got:
            a, raw_a, b, raw_b = got
            i = j = place = 0
            while i < len(a):
                xs, ys, x, y = [], [], place, place
                while not xs or x != y:
                    if not xs or x < y:
                        xs.append((a[i], x, x + len(raw_a[i])))
                        x += len(raw_a[i])
                        i += 1
                    else:
                        ys.append((b[j], y, y + len(raw_b[j])))
                        y += len(raw_b[j])
                        j += 1
                place = x
                groups.append((xs, ys))
                links += [(p[0], q[0]) for p in xs for q in ys if p[1] < q[2] and q[1] < p[2]]
        docs.append((got, groups, links))
        holders.update(set(links))
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    out = []
    for got, groups, links in docs:
        text = ";".join(",".join(str(x[0]) for x in xs) + "|" + ",".join(str(y[0]) for y in ys) for xs, ys in groups)
        out.append((len(got[0]) if got else 0, len(got[2]) if got else 0, len(groups), len(links), sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if got else ""))
    return out


ODD = [
    None, "", " ", "a", " lead", "trail ", "two  spaces", "tab\there", "line\nbreak", "line\n", "\n\nlines\n\n b", "<s> </s> <|endoftext|> <unk>", "<0x41>", "mark ▁ inside", "été à la", "你好世界", "\U0001f600 smile \U0001f600\U0001f600",
    "x" * 5000, "ﬁne ligature", "　wide", "nul \x00 byte", "don't  can't 12345 3.14", "same text here", "same text here", "same text there", "é combining", " nbsp", "a\r\nb", "<|endoftext|>",
]
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [60, 1 << 22])
def test_equals_brute_force(spark, block):
    rows = [(i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in token_align.align(docs, A, B, block).collect()}
    for (i, t), want in zip(rows, brute(ODD), strict=True):
        assert got[i] == want, (i, t)


def test_documents_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in token_align.align(docs, A, B, 1 << 16).collect()}
    want = brute([r.text for r in rows])
    assert len(got) == len(rows) and all(got[r.doc_id] == w for r, w in zip(rows, want, strict=True))
    assert sum(w[3] for w in want) > 10_000


def test_repeated_rows_clashing_names_and_no_rows(spark):
    rows = [(1, "some words", "x", 1), (1, "some words", "x", 1), (None, "some words", None, 2), (2, None, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, found int")
    got = sorted(token_align.align(docs, A, B).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [1, 1, 2, None]
    assert got[0] == got[1] and got[0].count_sum == 3 * got[0].n_links and got[0].n_best == got[0].n_links
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert token_align.align(docs.limit(0), A, B).count() == 0


def test_links_of_random_cuts():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = []
        for _ in range(2):
            cut = np.unique(np.append(rng.integers(1, 40, rng.integers(1, 12)), 40))
            sizes.append(np.diff(np.concatenate(([0], cut))))
        a, b = (np.arange(len(s)) for s in sizes)
        got = token_align.Aligned(a, np.array([0, len(a)]), b, np.array([0, len(b)]), *sizes)
        ends = [np.cumsum(s) for s in sizes]
        want = [(i, j) for i in a for j in b if ends[0][i] - sizes[0][i] < ends[1][j] and ends[1][j] - sizes[1][j] < ends[0][i]]
        assert sorted(zip(*(x.tolist() for x in got.pairs()), strict=True)) == want
        assert got.at_group[1] == len(set(ends[0]) & set(ends[1]))
