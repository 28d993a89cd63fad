"""Index tables: chunks by token windows, term postings, document frequencies, corpus statistics.

A chunk row is (tenant, collection, document_id, chunk_index, chunk_id, text); postings are one row a chunk and term
(``stored`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def token_windows(tokens: Column, size: int, overlap: float) -> Column:
    """Windows of ``size`` tokens, each sharing floor(overlap * size) with the one before; the last may be shorter."""
    if size <= 0:
        return F.when(F.size(tokens) > 0, F.array(tokens)).otherwise(F.array().cast("array<array<string>>"))
    shared = int(min(max(overlap, 0.0), 0.9) * size)
    step = size - shared
    n = F.size(tokens)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i * step + 1, size))


def chunk_documents(docs: DataFrame, size: int = 600, overlap: float = 0.15) -> DataFrame:
    """Chunks of ``docs(tenant, collection, document_id, text)`` by windows of space-separated tokens."""
    rows = docs.select("tenant", "collection", "document_id", F.posexplode(token_windows(T.words("text"), size, overlap)).alias("chunk_index", "window"))
    return with_chunk_ids(rows.withColumn("text", F.array_join("window", " ")).drop("window"))


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", T.chunk_uuid("tenant", "document_id", "chunk_index"))


#: Bytes of text of a slice whose terms are counted at once.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some ``most`` bytes of ``text``."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x)


def _split(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The terms of lower-cased ``text``, and the row of each."""
    split = pc.split_pattern_regex(pc.fill_null(rows.column("text"), ""), pattern=r"[^\p{L}\p{N}]+")
    terms, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    some = pc.not_equal(terms, "")
    return terms.filter(some), owner[some.to_numpy(zero_copy_only=False)]


def _runs(keep: tuple[str, ...]):
    """Rows (keep..., term, tf, length, places) of batches with lower-cased ``text``: all texts of a slice are split,
    coded and sorted at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                terms, owner = _split(rows)
                if not len(owner):
                    continue
                length = np.bincount(owner, minlength=rows.num_rows)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
                coded = terms.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(owner * len(coded.dictionary) + code, kind="stable")
                owner, code = owner[order], code[order]
                at = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))))
                ends = np.append(at, len(owner))
                places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32)))
                kept = [rows.column(c).take(pa.array(owner[at])) for c in keep]
                yield pa.record_batch([*kept, coded.dictionary.take(pa.array(code[at])), pa.array(np.diff(ends).astype(np.int32)), pa.array(length[owner[at]].astype(np.int32)), places], names=[*keep, "term", "tf", "length", "places"])

    return run


def term_counts_of(units: DataFrame, key: str, terms: pa.Array, text: str = "text") -> DataFrame:
    """(key, length, codes, tfs): a row a unit, with the places in ``terms`` of those it holds and how often; ``length``
    counts all its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                found, owner = _split(rows)
                length = np.bincount(owner, minlength=rows.num_rows)
                code = pc.index_in(found, value_set=terms)
                known = code.is_valid().to_numpy(zero_copy_only=False)
                code = code.drop_null().to_numpy().astype(np.int64)
                at, tf = np.unique(owner[known] * max(1, len(terms)) + code, return_counts=True)
                ends = np.searchsorted(at, np.arange(rows.num_rows + 1) * max(1, len(terms))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (at % max(1, len(terms)), tf)]
                yield pa.record_batch([rows.column(key), pa.array(length.astype(np.int32)), *lists], names=[key, "length", "codes", "tfs"])

    kind = units.schema[key].dataType.simpleString()
    return units.select(key, F.lower(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, length int, codes array<int>, tfs array<int>")


def places(units: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep..., term, tf, length, places) of ``units``: where each term stands in a unit, counted from 0.

    Counted inside each text, so nothing is shuffled.
    """
    rows = units.select(*keep, F.lower(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(_runs(keep), f"{schema}, term string, tf int, length int, places array<int>")


def postings(units: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, term, tf, length) of ``units``."""
    return places(units, key, text=text).drop("places")


def corpus_stats(documents: DataFrame) -> DataFrame:
    """Per tenant and collection: documents, tokens, and their average (0 without documents)."""
    sums = documents.groupBy("tenant", "collection").agg(F.count(F.lit(1)).alias("total_docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"))
    return sums.withColumn("avgdl", F.when(F.col("total_docs") > 0, F.col("total_tokens") / F.col("total_docs")).otherwise(F.lit(0.0)))


def average_length(stats: DataFrame, wanted: DataFrame, default: float) -> DataFrame:
    """The average length of each wanted (tenant, collection), or the default where nothing is stored."""
    found = wanted.join(stats, ["tenant", "collection"], "left")
    return found.select("tenant", "collection", F.coalesce("total_docs", F.lit(0)).alias("total_docs"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.when(F.col("total_docs") > 0, F.col("avgdl")).otherwise(F.lit(default)).alias("avgdl"))


def check_vectors(points: DataFrame, dim: int, column: str = "dense") -> DataFrame:
    """The points, with an error on the first vector of another size."""
    ok = F.assert_true(F.size(column) == dim, F.lit(f"a dense vector does not have the collection's {dim} components"))
    return points.where(ok.isNull())


def payload() -> Column:
    """What a point tells of its chunk, from the columns of the chunk and its document's metadata."""
    return F.struct("tenant", "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", "title", "source_url", "source_domain", "language", "collection", "section_heading", F.to_json("tags").alias("tags"))


def index_points(chunks: DataFrame, metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """The wide index table: chunk, its vector and the metadata that retrieval needs, so that a hit needs no join."""
    joined = chunks.join(metadata, ["tenant", "document_id"]).join(vectors, "chunk_id")
    return joined.select("chunk_id", payload().alias("payload"), "dense")
