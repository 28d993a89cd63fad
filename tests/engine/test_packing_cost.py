import random
import re

import pyarrow as pa

from tessera.functions import packing as P
from tessera.operators import chunking as CH

TEXTS = ["", " ", "a", "one two  three ", "\x1c a\x85b\u2003c \u200b", "Über alles. Und 3.5 dann! 漢字。 " * 40, " x" * 300, "p\n\nq r\n" * 90, "# T\n" + "word. " * 200, "a\fb c\f" * 60]


def test_words_as_text_are_the_words_as_bytes():
    words = P.word_tokens()
    plain = P.Tokens(lambda text: [m.encode() for m in re.findall(r"\s*\S+|\s+\Z", text)])
    r = random.Random(3)
    for text in TEXTS + ["".join(r.choices("ab .\n\t\x1fé漢\u3000", k=400)) for _ in range(50)]:
        assert "".join(words.split(text)).encode() == b"".join(plain.encode(text)) and words.count(text) == plain.count(text)
        for strategy in P.STRATEGIES:  # one after the other, so that what is remembered is used
            assert P.chunk(text, strategy, 20, 0.15, words) == P.chunk(text, strategy, 20, 0.15, plain)


def test_a_text_is_cut_once_for_strategies_that_cut_alike():
    words, asked = P.word_tokens(), []
    split = words.split
    words.split = lambda text: asked.append(text) or split(text)
    for strategy in ("tokens", "pages", "page_tokens", "semantic"):
        P.chunk("a b c " * 50, strategy, 20, 0.15, words)
    assert len(asked) == 1


def test_chunks_leave_a_task_by_parts_of_its_batch(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(CH, "SLICE_BYTES", 2000)
    docs = spark.createDataFrame([(i, "w " * 500, "tokens") for i in range(40)] + [(40, None, "tokens"), (41, "", "chars")], "document_id long, text string, strategy string")
    batch = pa.RecordBatch.from_pydict({"document_id": list(range(40)), "text": ["w " * 500] * 40, "strategy": ["tokens"] * 40, "max_tokens": pa.array([64] * 40, pa.int32()), "overlap_ratio": [0.15] * 40})
    kept = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.append(run) or kept(self, run, schema))
    found = CH.chunked(docs, 64, 0.15, tokenizer="words")
    assert len(list(seen[0](iter([batch])))) >= 20 and found.groupBy("document_id").count().count() == 40
