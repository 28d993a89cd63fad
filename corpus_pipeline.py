"""A training-data pipeline of four stages over ``documents``.

1. language ID: rows without a language (no letter, no text) or whose language is uncertain go;
2. n-gram Jaccard join: of each group of linked documents, the one with the smallest doc_id stays;
3. mixing: sources are brought to target weights; a document is repeated as often as the mix takes it, in part
   counting as once, and goes if the mix does not reach it;
4. SentencePiece: every row is encoded and decoded; ids come with the documents' columns.

Each stage is written as Parquet and read again as the next one's input, which is removed once that one is written.  Edge cases are those of the operators: null
and empty texts go in the first stage, repeated rows of one doc_id count as one node in the second and are all kept,
and empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, mixing, ngram_join, piece_codec
from tessera.llm.common import checkpoint, remove, shared_dir, sized_broadcast, table
from tessera.llm.queries import tokenizer_file
from tessera.session import ensure_importable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this probability no language is told.
LEAST_SCORE = 0.35


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what language ID rejects."""
    docs = docs.select(*COLUMNS)
    judged = language_id.predict(docs, language_id.train(docs), keep=COLUMNS)
    return judged.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each linked group."""
    parts = ngram_join.jaccard_components(docs.select("doc_id", "text"), links=False)
    gone = checkpoint(parts.where("doc_id != component_id").select("doc_id").distinct())
    return docs.join(sized_broadcast(gone), "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it."""
    times = checkpoint(mixing.copies(mixing.mix_sources(docs)))
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    times = sized_broadcast(times).withColumnsRenamed({"doc_id": "mixed_id", "size": "mixed_size"})
    taken = docs.withColumn("size", size).join(times, F.col("doc_id").eqNullSafe(F.col("mixed_id")) & (F.col("size") == F.col("mixed_size")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add SentencePiece ids and whether they decode to the text."""
    path = tokenizer_file("piece_bpe_32k.model")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    back = piece_codec.encode(rows, path, back=True)
    return back.select("doc_id", "n_pieces", "ids_crc32", "ids", F.length("decoded").cast("long").alias("n_chars"), F.sha2(F.col("decoded").cast("binary"), 256).alias("text_sha"))


STAGES = [("language_id", identify), ("ngram_jaccard_join", deduplicate), ("source_mixing", mix), ("sentencepiece", encode)]

#: The first stage is a trained network, so no SQL gives these rows; tests/llm compare them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again."""
    ensure_importable(spark)
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
