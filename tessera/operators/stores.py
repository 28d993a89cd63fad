"""Table maintenance without MERGE: upserts, replacements and deletes as joins; writes are whole-table or by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("age", F.row_number().over(w)).where("age = 1").drop("age")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], now: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key: created_at stays as it was, updated_at is bumped."""
    now = F.current_timestamp() if now is None else now
    stamps = old.select(*keys, F.col("created_at").alias("first_created"))
    changed = new.join(stamps, keys, "left").withColumn("created_at", F.coalesce("first_created", now)).withColumn("updated_at", now).drop("first_created")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(changed.select(*old.columns))


def replace_chunks(old: DataFrame, new: DataFrame, touched: DataFrame, documents: DataFrame, keys: tuple[str, ...] = ("tenant", "document_id")) -> DataFrame:
    """All chunks of touched documents replaced by their new ones; chunks of unknown documents are refused."""
    known = documents.select(F.col("tenant"), F.col("id").alias("document_id"))
    return old.join(touched.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.join(known, list(keys), "left_semi"))


def delete_document(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the documents ``gone(tenant, id)``."""
    g = gone.select("tenant", "id").distinct()
    return documents.join(g, ["tenant", "id"], "left_anti"), chunks.join(g.withColumnRenamed("id", "document_id"), ["tenant", "document_id"], "left_anti")


def delete_points(points: DataFrame, tenant: str, document: str) -> DataFrame:
    p = F.col("payload")
    return points.where(~((p["tenant"] == tenant) & (p["document_id"] == document)))


def unchanged(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``skip``: whether the stored document has the same checksum."""
    known = stored.select("tenant", F.col("id").alias("document_id"), F.col("checksum").alias("stored_checksum"))
    return incoming.join(known, ["tenant", "document_id"], "left").withColumn("skip", F.coalesce(F.col("checksum") == F.col("stored_checksum"), F.lit(False))).drop("stored_checksum")


def stats_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes of corpus statistics between two states of the documents: tenant, collection, docs, tokens."""
    signed = lambda d, s: d.where("stats_collection is not null").select("tenant", F.col("stats_collection").alias("collection"), F.lit(s).alias("docs"), (F.coalesce("stats_token_count", F.lit(0)) * s).alias("tokens"))
    moved = signed(before, -1).unionByName(signed(after, 1)).groupBy("tenant", "collection").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return moved.where("docs != 0 or tokens != 0")


def apply_deltas(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """Statistics after the changes; collections left without documents stay with zeros."""
    both = stats.select("tenant", "collection", F.col("total_docs").alias("docs"), F.col("total_tokens").alias("tokens")).unionByName(deltas)
    sums = both.groupBy("tenant", "collection").agg(F.sum("docs").alias("total_docs"), F.sum("tokens").alias("total_tokens"))
    return sums.withColumn("avgdl", F.when(F.col("total_docs") > 0, F.col("total_tokens") / F.col("total_docs")).otherwise(F.lit(0.0)))


def collections(points: DataFrame) -> DataFrame:
    return points.select("collection").distinct()


def fetch_document(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each document with all its chunks, in order, as one JSON object."""
    listed = chunks.groupBy("tenant", F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("chunks"))
    joined = documents.join(listed, ["tenant", "id"], "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<chunk_index:int,text:string>>")))
    return joined.select("tenant", "id", F.to_json(F.struct("id", "title", "collection", "language", "chunks")).alias("document"))


def append_owned(old: DataFrame, new: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages appended if their conversation belongs to their tenant."""
    return old.unionByName(new.join(conversations.select("tenant", F.col("id").alias("conversation_id")), ["tenant", "conversation_id"], "left_semi").select(*old.columns))
