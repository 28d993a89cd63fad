"""Ingestion as one plan: documents to skip split, chunks, ids, vectors, index rows and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking, index, retrieval, stores

#: What the chunks of a document know of it besides their text.
METADATA = ("title", "source_url", "source_domain", "language", "tags")
Embed = Callable[[Column], Column]
COUNTERS = "documents long, skipped long, failed long, chunks long"

def prepared(files: DataFrame, tenant: str, collection: str | None = None, default_collection: str = "demo") -> DataFrame:
    """Documents from ``sources.files.documents``: ids, titles, collections, checksums; rows with an error keep it.

    Collection: the request's, else the sidecar's, else the default; id: the sidecar's, else the file's stem; title:
    the sidecar's, else the file's own (here empty).
    """
    s = F.col("sidecar")
    side_collection = F.coalesce(T.empty_to_null(s["ingestion"]["collection"]), T.empty_to_null(s["source"]["collection"]))
    return files.select(
        F.lit(tenant).alias("tenant"), F.coalesce(T.empty_to_null(s["document"]["id"]), F.col("stem")).alias("document_id"), F.coalesce(T.empty_to_null(s["document"]["title"]), F.lit("")).alias("title"),
        F.coalesce(F.lit(collection), side_collection, F.lit(default_collection)).alias("collection"), s["language"].alias("language"), s["source"]["url"].alias("source_url"), s["source"]["domain"].alias("source_domain"),
        F.coalesce(s["tags"], F.array().cast("array<string>")).alias("tags"), s["ingestion"]["chunking"]["strategy"].alias("configured"), s["ingestion"]["chunking"]["max_tokens"].alias("max_tokens"),
        s["ingestion"]["chunking"]["overlap_ratio"].alias("overlap_ratio"), "path", "text", T.checksum("text").alias("checksum"), "error",
    )


def prepared_rows(rows: DataFrame, tenant: str, collection: str) -> DataFrame:
    """``prepared`` for ``rows(document_id, text)`` of a table or a stream, with ``title``, ``language`` and ``collection``
    (else the one given) if there; of rows with one id the last by text stays."""
    extra = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("title", "language", "collection")}
    own = rows.select(F.col("document_id").cast("string").alias("document_id"), F.col("text").cast("string").alias("text"), *(v.cast("string").alias(c) for c, v in extra.items()))
    last = lambda rows: rows.groupBy("document_id").agg(F.max(F.struct("text", "title", "language", "collection")).alias("d")).select("document_id", "d.*")
    # Only rows whose id comes again meet each other, if such ids are few; the others' texts are not shuffled.
    again = own.groupBy(F.col("document_id").alias("again")).count().where("count > 1").select("again")
    most = max(1, retrieval.SMALL_BYTES // retrieval.row_bytes(again))
    if again.limit(min(retrieval.SMALL_ROWS, most) + 1).count() <= min(retrieval.SMALL_ROWS, most):
        meets = lambda how: own.join(F.broadcast(again), F.col("document_id").eqNullSafe(F.col("again")), how)
        one = meets("left_anti").unionByName(last(meets("left_semi")))
    else:
        one = last(own)
    none = lambda kind: F.lit(None).cast(kind)
    broken = F.when(F.col("document_id").isNull() | (F.col("document_id") == ""), "a document needs an id").when(F.col("text").isNull(), "a document needs a text")
    return one.select(
        F.lit(tenant).alias("tenant"), "document_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("collection", F.lit(collection)).alias("collection"), "language", none("string").alias("source_url"), none("string").alias("source_domain"),
        F.array().cast("array<string>").alias("tags"), none("string").alias("configured"), none("int").alias("max_tokens"), none("double").alias("overlap_ratio"), none("string").alias("path"), "text", T.checksum("text").alias("checksum"), broken.alias("error"),
    )


def outcome(prepared_docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``skip``: unchanged documents and those with errors are not chunked."""
    split = stores.unchanged(prepared_docs, stored)
    return split.withColumn("skip", F.col("skip") | F.col("error").isNotNull())


def chunk_rows(docs: DataFrame, size: int = 600, overlap: float = 0.15, also: tuple[str, ...] = (), **tokens) -> DataFrame:
    """Chunks of changed documents: tenant, document_id, collection, columns of the documents asked for ``also``,
    chunk_index, text, section columns, chunk_id."""
    strategy = chunking.selected_strategy("configured", "text")
    rows = docs.where(~F.col("skip")).withColumn("strategy", strategy)
    made = chunking.chunked(rows, size, overlap, keep=("tenant", "document_id", "collection", *also), **tokens)
    return index.with_chunk_ids(made)


def points_of(chunks: DataFrame, docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index points: the chunk's vector, from ``vectors(chunk_id, dense)``, and all metadata retrieval needs."""
    meta = docs.select("tenant", "document_id", *METADATA)
    return index.index_points(chunks.withColumn("section_heading", F.col("section_title")), meta, vectors.select("chunk_id", "dense"))


def points_with(chunks: DataFrame) -> DataFrame:
    """Index points of chunks that carry their ``METADATA`` and ``dense``; no join."""
    return chunks.withColumn("section_heading", F.col("section_title")).select("chunk_id", index.payload().alias("payload"), "dense")


def index_rows(chunks: DataFrame, docs: DataFrame, embed: Embed) -> DataFrame:
    """``points_of`` with vectors from an embedding of the text column."""
    return points_of(chunks, docs, chunks.select("chunk_id", embed(F.col("text")).alias("dense")))


def stored_documents(docs: DataFrame, chunks: DataFrame, size: int = 600) -> DataFrame:
    """Rows for the documents table.  The token count of a document is its number of chunks times the budget, and null
    for unchanged documents."""
    counted = chunks.groupBy("tenant", "document_id").agg((F.count(F.lit(1)) * size).alias("token_count"))
    return docs.where("error is null").join(counted, ["tenant", "document_id"], "left").select("tenant", F.col("document_id").alias("id"), "title", "language", "collection", "checksum", "token_count")


def moved(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows for the documents table of unchanged documents whose title, language or collection is another one now."""
    old = stored.select("tenant", "id", "token_count", *(F.col(c).alias(f"old_{c}") for c in ("title", "language", "collection")))
    rows = docs.where("error is null and skip").select("tenant", F.col("document_id").alias("id"), "title", "language", "collection", "checksum").join(old, ["tenant", "id"])
    same = F.col("title").eqNullSafe(F.col("old_title")) & F.col("language").eqNullSafe(F.col("old_language")) & F.col("collection").eqNullSafe(F.col("old_collection"))
    return rows.where(~same).select("tenant", "id", "title", "language", "collection", "checksum", "token_count")


def counters(docs: DataFrame, chunks: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row: documents (skipped ones included), skipped, failed, and chunks (0 on a dry run)."""
    fine = F.col("error").isNull()
    got = docs.agg(F.count_if(fine).alias("documents"), F.count_if(F.col("skip") & fine).alias("skipped"), F.count_if(~fine).alias("failed"))
    return got.withColumn("chunks", F.lit(0).cast("long")) if dry_run else got.join(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("chunks"))))


def failures(docs: DataFrame) -> DataFrame:
    """A row (path, error) for each document that failed."""
    return docs.where("error is not null").select("path", "error")
