import random
import zlib

import numpy as np
import pytest

from tessera.llm import piece_codec as C
from tessera.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n, seed=2):
    r = random.Random(seed)
    parts = ["the", " ", "  ", "ing", "tion", "é", "漢字", "😀", "\n", "\t", "aaaa", "lo", "x", "1234", "▁", ".", "ﬁ", "er", "\x00"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(n)]


def test_equals_the_library_and_decodes(library):
    use = C.Pieces(PATH)
    for t in texts(1500):
        ids = np.frombuffer(use.encode_words(C.normalised(t)), "<i4").tolist()
        assert ids == library.encode(t), t
        assert use.decode(ids) == t.replace("▁", " ")


@pytest.mark.parametrize("chunk", [40, 57])
def test_chunks_without_words_meet_by_their_matrices(library, chunk):
    use = C.Pieces(PATH)
    r = random.Random(chunk)
    for _ in range(12):
        t = "".join(r.choice(["international", "ization", "aaaa", "é", "漢字", "tion", "s", "th"]) for _ in range(90))
        text = C.normalised(t)
        at = C.cuts(text, chunk)
        matrices = [use.transfer(text, a, b) for a, b in zip(at[:-1], at[1:])]
        states = C.scan(matrices)
        pieces = [p for (a, b), s, e in zip(zip(at[:-1], at[1:]), states[:-1], states[1:]) for p in use.backtrace(text, a, b, s, e)]
        assert use.numbers(pieces) == library.encode(t)


@pytest.mark.parametrize("chunk", [40, 61])
def test_chunks_cut_inside_words(library, chunk):
    use = C.Pieces(PATH)
    for seed in range(6):
        t = " ".join(["international", "a", "organization", "  x", "漢字漢字", "tionally's", "été"][i % 7] + str(i * seed) for i in range(60)) + " " * seed
        text = C.normalised(t)
        at = C.cuts(text, chunk)
        assert any(not C.boundary(text, a) for a in at[1:-1])
        matrices = [use.chunk_matrix(text, a, b) for a, b in zip(at[:-1], at[1:])]
        assert any(len(m[0]) > 1 for m in matrices)
        states = C.scan(matrices)
        got = b"".join(use.chunk_ids(text, a, b, s, e) for a, b, s, e in zip(at[:-1], at[1:], states[:-1], states[1:]))
        assert np.frombuffer(got, "<i4").tolist() == library.encode(t)
        whole = use.transfer(text, 0, len(text))
        joined = matrices[0]
        for m in matrices[1:]:
            joined = C.product(joined, m)
        assert joined == whole  # the product does not depend on the cuts


def test_documents_with_chunks(spark, library):
    giant = " ".join(texts(3000, 9))
    solid = "antidisestablishment" * 40
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, " "), (5, giant), (6, solid), (6, "again"), (None, "none")]
    df = spark.createDataFrame([(i, d, t, 5) for i, (d, t) in enumerate(rows)], "row long, doc_id long, text string, k int")
    got = {r.row: (r.ids_crc32, r.decoded) for r in C.decode(C.encode(df, PATH, chunk=300), PATH).collect()}
    want = {i: (zlib.crc32(np.array(library.encode(t or ""), "<i4").tobytes()), (t or "").replace("▁", " ")) for i, (_, t) in enumerate(rows)}
    assert got == want
    assert C.encode_documents(df.limit(0), PATH).count() == 0


def giant(kind, n, seed=5):
    r = random.Random(seed)
    zh = [chr(0x4E00 + 7 * k) for k in range(900)]
    return {"words": lambda: " ".join(r.choice(["some", "words", "internationalization", "été"]) for _ in range(n // 6)), "cjk": lambda: "".join(r.choice(zh) for _ in range(n)), "same": lambda: "é" * n, "code": lambda: "".join(r.choice(["self.", "x=[", "foo_bar", ");", "1234"]) for _ in range(n // 4))}[kind]()


@pytest.mark.parametrize("kind", ["cjk", "same", "code"])
def test_long_words_in_windows(library, kind):
    use = C.Pieces(PATH)
    for n in (250, 257, 3000, 20_001):
        t = giant(kind, n)
        assert np.frombuffer(use.encode_batch([t])[0], "<i4").tolist() == library.encode(t)


@pytest.mark.parametrize("rows", [["words"], ["cjk"], ["same", "code", "words"], ["code", "", None, "words", "cjk", "tiny"]])
def test_giants_at_the_query_chunk_size(spark, library, rows):
    """One giant, only giants, and giants between short and empty texts."""
    texts = [x if x in ("", None) else "a short text" if x == "tiny" else giant(x, 150_000) for x in rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in C.encode_documents(docs, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (got[i].n_pieces, got[i].ids_crc32, got[i].n_chars) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), len(t or ""))


def test_two_slices_of_giants_beside_short_ones(spark, library):
    texts = ["short", giant("words", 1_300_000), giant("words", 1_200_000, 6), "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_pieces for r in C.encode_documents(docs, PATH).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(texts)}
