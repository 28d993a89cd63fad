"""The ``opN_<name>`` queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.session import spread

from . import bit_topk, html_text, language_id, line_runs, mixing, ngram_join, phrases, piece_codec, polytope, ppm, token_align, token_store, warc
from .common import table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, on all cores also where they are read in few splits."""
    return spread(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.search(table(spark, sf_dir, "embeddings"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(spread(table(spark, sf_dir, "pages")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_digests(documents(spark, sf_dir))


OPERATORS = (op1_ngram_jaccard_join, op2_token_output, op3_sentencepiece, op4_warc, op5_nearest_neighbours, op6_exact_topk, op7_language_id, op8_html_extraction, op9_lm_scoring, op10_source_mixing, op11_token_alignment, op12_phrase_collocations, op13_line_dedup)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (*OPERATORS, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": ngram_join.SQL, "op4_warc": warc.SQL, "op6_exact_topk": bit_topk.SQL, "op10_source_mixing": mixing.SQL, "op12_phrase_collocations": phrases.SQL, "op13_line_dedup": line_runs.SQL}
