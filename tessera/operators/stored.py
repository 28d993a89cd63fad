"""The stored inverted index: postings with places, document frequencies and the number of units.

Postings are counted inside each text, so building them shuffles each posting once, to its bucket.  A bucket holds all
terms of its units, sorted by term: a change of some documents replaces their buckets alone, no bucket is hot whatever
its terms, and a search skips the row groups that none of its terms can be in.  Searches read postings, never texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import places

BUCKETS = 64


def bucket_of(*keys: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def postings(units: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep..., term, tf, length, places) of ``units``; places count terms from 0."""
    return places(units, *keep, text=text)


def term_counts(rows: DataFrame, *by: str) -> DataFrame:
    """How many units hold each term."""
    return rows.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))


@dataclass
class StoredIndex:
    """``postings(key, term, tf, length, places)``, ``terms(term, df)`` and ``units(key)`` of a collection; ``count``, one
    row with ``n``, where the number of units is stored."""

    postings: DataFrame
    terms: DataFrame
    units: DataFrame
    key: str = "key"
    count: DataFrame | None = None

    def total(self) -> DataFrame:
        return self.count if self.count is not None else self.units.agg(F.count(F.lit(1)).alias("n"))


def write(units: DataFrame, path: str, key: str = "key", text: str = "text", buckets: int = BUCKETS) -> str:
    """Index ``units(key, text)`` under ``path``."""
    made = postings(units, key, text=text).withColumn("bucket", bucket_of(key, buckets=buckets))
    made.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = units.sparkSession
    term_counts(spark.read.parquet(f"{path}/postings").select("term")).sort("term").write.parquet(f"{path}/terms")
    units.select(key).write.parquet(f"{path}/units")
    return path


def read(spark: SparkSession, path: str, key: str = "key") -> StoredIndex:
    return StoredIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "units")), key)
