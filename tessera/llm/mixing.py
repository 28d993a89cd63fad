"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key (md5 of seed and doc_id).  The key's first twelve bits cut each source into
4096 ranges; ranges are sorted on their own, and prefix sums of token counts are taken in two levels: over a
source's range totals (at most 4096 rows a source) and inside each range.  So one hot source is spread over 4096
groups, and no task holds a source.  A source's target is cut at its exact budget: whole epochs first, then the
documents in key order, the last one in part.

Sources are ranked by code point, null last; weights repeat over the ranks.  Targets share 100 % of all tokens by
weight, but stop at ``epochs`` times a source's size; the excess goes to the others by weight until none is above.

Edge cases.  Null, empty or all-space text has size 0 and is never taken.  A null source is a source of its own;
so is the empty string.  There may be as many sources as rows: they are ranked and summed over range-sorted partitions.  Rows that share a doc_id are separate documents next to each other in key order; a null
doc_id has a key of its own.  Sources without tokens get target 0.  Empty tables give no rows.  Other columns are
ignored, whatever their names.  Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, sized_broadcast

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix"


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, the source as a null-safe key (none, src), size in words, and the random key."""
    doc = F.col("doc_id").cast("string")
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("none"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc, F.lit("null")))).alias("key"),
    ).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))


def sums_before(rows: DataFrame, order: list[str], **sums) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum of its column over all rows that come earlier in ``order``.

    Rows are range-sorted over partitions; sums are taken in each, and over the partitions' totals.
    """
    placed = checkpoint(rows.select("*", *(c.cast("long").alias(f"{n}_") for n, c in sums.items())).orderBy(*order).withColumn("place", F.spark_partition_id()))
    totals = placed.groupBy("place").agg(*(F.sum(f"{n}_").alias(f"{n}_") for n in sums))
    over = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = totals.select("place", *(F.coalesce(F.sum(f"{n}_").over(over), F.lit(0)).alias(f"{n}_first") for n in sums))
    inside = Window.partitionBy("place").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(sized_broadcast(totals), "place")
    return found.select(*rows.columns, *((F.col(f"{n}_first") + F.coalesce(F.sum(f"{n}_").over(inside), F.lit(0))).alias(n) for n in sums))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sources(none, src, source_size)``, one row a source, with its ``target``: shares by weight under the caps."""
    ranked = sums_before(sources, ["none", "src"], rank=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    rows = ranked.withColumn("w", weight).withColumns({"cap": F.col("source_size") * epochs, "ratio": F.col("source_size") / F.col("w")})
    rows = checkpoint(sums_before(rows, ["ratio", "none", "src"], spent=F.col("cap"), closed=F.col("w")))
    everything, weighed = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    # In rising order of size by weight, a source is capped if its share of what the earlier caps left is above its cap.
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  the products may leave 64 bits
    rows = rows.withColumn("capped", wide(F.lit(everything) - F.col("spent")) * wide(F.col("w")) > wide(F.col("cap")) * wide(F.lit(weighed) - F.col("closed")))
    kept, free = rows.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)), F.sum(F.when(~F.col("capped"), F.col("w")))).first()
    share = (F.lit(everything - kept).cast("long") * F.col("w")).cast("double") / F.lit(free).cast("double")
    return rows.select("none", "src", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Per row of ``docs(doc_id, text, source)``: doc_id, size, source_size, target, taken, and source."""
    rows = checkpoint(sized(docs, seed))
    ranges = rows.groupBy("none", "src", "bucket").agg(F.sum("size").alias("range_size"))
    source = targets(ranges.groupBy("none", "src").agg(F.sum("range_size").alias("source_size")), weights, epochs)
    earlier = Window.partitionBy("none", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size").join(source, ["none", "src"])
    inside = Window.partitionBy("none", "src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("until", F.sum("size").over(inside)).join(starts, ["none", "src", "bucket"])
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size") - (F.col("start") + F.col("until") - F.col("size"))
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.when(~F.col("none"), F.col("src")).alias("source"))


def copies(mixed: DataFrame) -> DataFrame:
    """How often the mix repeats a document: (doc_id, size, copies), a part counting as one."""
    return mixed.where("taken > 0").groupBy("doc_id", "size").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
sources AS (
  SELECT none, src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY none, src),
weighted AS (
  SELECT *, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY none, src) - 1) % 3 + 1 AS INTEGER)) AS BIGINT) AS w FROM sources),
filled AS (
  SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent,
         CAST(sum(w) OVER (ORDER BY source_size / w, none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM weighted),
capped AS (SELECT *, (total - spent) * w > cap * open AS capped FROM filled),
shared AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS BIGINT) AS free FROM capped),
targets AS (
  SELECT none, src, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST((total - kept) * w AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM shared),
placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY s.none, s.src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM sized s JOIN targets t ON s.none = t.none AND s.src = t.src)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS taken,
       CASE WHEN NOT none THEN src END AS source
FROM placed
"""
