"""Where queries register: a name, a function of (spark, folder), and the SQL that gives the same rows, if any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stored
from ..session import exists, move, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the engine's document rows."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("default").alias("tenant"), F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("document_id"), "text", "lang")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index_of(spark: SparkSession, sf_dir: str, name: str, units: Callable[[SparkSession, str], DataFrame]) -> stored.StoredIndex:
    """The stored index of ``units(key, text)`` made from the documents: written once for a state of the table (its
    files with their sizes and times), in the shared folder, and read from then on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet").select(F.concat_ws(":", "path", "length", "modificationTime").alias("f"))
    state = files.agg(F.md5(F.array_join(F.sort_array(F.collect_list("f")), "|")).alias("state")).first().state
    path = f"{shared_dir(spark)}/index-{name}-{state}"
    if not exists(spark, f"{path}/units/_SUCCESS"):
        new = f"{path}-{uuid.uuid4().hex}"
        stored.write(units(spark, sf_dir), new)
        if not move(spark, new, path):
            path = new  # another writer was first and may still be at it
    return stored.read(spark, path)
