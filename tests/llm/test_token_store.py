import random
import zlib

import numpy as np
import pytest

from tessera.llm import token_store as S
from tessera.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
PARTS = ["a", "B", "'s", " ", "  ", "\n", "\t", "é", "漢", "😀", "1", "23", ".", ",", "<|endoftext|>", "\x00", "\xa0", " x", "\x1c", "\x85"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library():
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    e, t = S.Encoder(PATH), library()
    for i in range(0, len(texts), 7):
        part = texts[i : i + 7]
        assert [x.tolist() for x in e.encode(part)] == [x.ids for x in t.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 1 << 24, 2**32 - 1], list(range(0, 200_000, 37))])
def test_segments_give_any_token(values):
    ids = [np.array(values[: len(values) // 2], np.uint32), np.array(values[len(values) // 2 :], np.uint32)]
    s = S.Segment(S.pack([7, None], ids))
    assert s.doc_ids == [7, None]
    assert s.all().tolist() == values
    assert [s.document(k).tolist() for k in (0, 1)] == [x.tolist() for x in ids]
    for i in random.Random(1).sample(range(len(values)), min(50, len(values))):
        assert s.token(i) == values[i]


def test_documents_from_files(spark, tmp_path):
    long = "word " * 40_000
    rows = [(5, "Hello world"), (3, None), (9, ""), (3, "again\n two"), (None, "none"), (1, long)]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, part string, seq int")
    out = str(tmp_path / "tokens")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in S.token_documents(df, PATH, out).collect()]
    t, start, want = library(), 0, []
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    paths = sorted((tmp_path / "tokens").glob("part-*"))
    met = 0
    for path in paths:  # stand-alone files: any token by its address
        whole = S.Segment(path.read_bytes())
        with path.open("rb") as f:
            stored, every = S.SegmentFile(f), whole.all().tolist()
            assert (stored.n_tokens, stored.n_docs, stored.part, stored.first) == (whole.n_tokens, whole.n_docs, whole.part, whole.first)
            assert [stored.document(k) for k in range(stored.n_docs)] == list(zip(whole.offsets[:-1].tolist(), whole.offsets[1:].tolist()))
            for i in random.Random(2).sample(range(len(every)), min(len(every), 300)):
                assert stored.token(i) == every[i]
                met += 1
    assert met > 300
    assert S.token_documents(df.limit(0), PATH, str(tmp_path / "empty")).count() == 0


def test_small_segments_and_parts(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"word {i} and more" * (i % 5)) for i in range(200)], "doc_id long, text string")
    want = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in S.token_documents(df, PATH, str(tmp_path / "a")).collect()}
    monkeypatch.setattr(S, "SEGMENT_TOKENS", 40)
    S.write_tokens(df, PATH, str(tmp_path / "b"), part_bytes=300)
    assert len(list((tmp_path / "b").glob("part-*"))) > 8
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in S.read_documents(spark, str(tmp_path / "b")).collect()} == want
