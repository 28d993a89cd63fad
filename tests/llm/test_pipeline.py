import collections
import math

from test_ngram_join import brute as components

import corpus_pipeline
from tessera.llm import language_id, mixing
from tessera.llm.queries import tokenizer_file


def test_run_equals_brute_force(spark, sf):
    import sentencepiece

    got = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = {r.doc_id: r for r in language_id.identify(docs).collect()}
    rows = [r for r in docs.collect() if told[r.doc_id].lang_pred != "und" and told[r.doc_id].score >= corpus_pipeline.LEAST_SCORE]
    assert len(rows) >= 0.98 * docs.count()
    keep = {int(d) for d, _, c, _ in components([(r.doc_id, r.text) for r in rows]) if d == c}
    rows = [r for r in rows if r.doc_id in keep]
    mixed = {r.doc_id: math.ceil(r.taken / r.size) if r.size else 0 for r in mixing.mix_sources(spark.createDataFrame(rows, docs.schema)).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = collections.Counter()
    for r in rows:
        if mixed[r.doc_id]:
            want[(r.doc_id, len(sp.encode(r.text)), len(r.text))] += mixed[r.doc_id]
    assert collections.Counter((r.doc_id, r.n_pieces, r.n_chars) for r in got) == want


def test_stages_take_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, "en", None, 0), (2, "", None, "a", 0), (None, "one two three four five six", "en", "a", 1), (3, "one two three four five six", "en", "a", 1), (3, "the other words of this text", "en", None, 1), (4, "99", "en", "b", 2)], schema)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, rows, sf).count() >= 0, name
    assert sorted((str(r.doc_id), r.text) for r in corpus_pipeline.identify(spark, docs, sf).collect()) == sorted((str(r.doc_id), r.text) for r in docs.where("text like '% text' or text like '% six'").collect())
    assert [f.name for f in corpus_pipeline.mix(spark, docs, sf).schema] == list(corpus_pipeline.COLUMNS)
