"""Reciprocal rank fusion as one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .retrieval import RRF_K

#: Columns of which the first value in source order is kept.
FIRST = ("document_id", "chunk_index", "text", "title", "source_url", "source_domain", "language", "tags", "section_heading", "collection")


def fuse(hits: DataFrame, k: int = RRF_K, key: str = "chunk_id") -> DataFrame:
    """Fuse ``hits(query_id, source, source_order, rank, key, score, ...)``, rank counting from 1 in each source.

    A hit adds 1 / (k + rank).  Of the metadata columns that are there, the first value in source order that is not
    null (for lists: not empty) is kept.  ``sources`` and ``source_scores`` follow source order; ties go to the key.
    """
    place = F.struct("source_order", "rank")
    kept = []
    for c in (c for c in FIRST if c in hits.columns):
        value = F.when(F.size(c) > 0, F.col(c)) if dict(hits.dtypes)[c].startswith("array") else F.col(c)
        kept.append(F.min_by(value, F.when(value.isNotNull(), place)).alias(c))
    visits = F.sort_array(F.collect_list(F.struct("source_order", "rank", "source", "score")))
    fused = hits.groupBy("query_id", key).agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + F.lit(float(k)))), 12).alias("fused_score"), visits.alias("visits"), *kept)
    once = F.map_from_entries(F.transform(F.array_distinct(F.transform("visits", lambda v: v["source"])), lambda s: F.struct(s, F.element_at(F.filter("visits", lambda v: v["source"] == s), -1)["score"])))
    named = fused.withColumn("sources", F.transform("visits", lambda v: v["source"])).withColumn("source_scores", once).drop("visits")
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), key)
    return named.withColumn("rank", F.row_number().over(order)).withColumn("score_type", F.lit("rrf_fused"))


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, key: str = "chunk_id") -> DataFrame:
    """Both legs fused; no limit beyond theirs."""
    # The legs hold a few rows a query.  Dealt alike by query_id, their union would be zipped by partition, which fails
    # where adaptive execution merges the partitions of one leg only.
    sparse = sparse.repartition(key)
    legs = [leg.withColumn("source", F.lit(name)).withColumn("source_order", F.lit(i)) for i, (name, leg) in enumerate((("dense", dense), ("sparse", sparse)))]
    return fuse(legs[0].unionByName(legs[1], allowMissingColumns=True), k, key)
