"""Line dedup: a line that many documents hold stays in the last of them alone.

Lines meet as 128-bit hashes of their keys (white space stripped at both ends, A-Z lower-cased), in levelled sorted runs.
Documents come in batches of descending doc_id.  A batch's own run has each key once, with the number of its documents
and the largest of them.  Merged against the runs there are, keys that those already give to enough documents fall out
(an anti-join: nothing more can change for them), and the rest becomes a run of level 0.  ``FANOUT`` runs of a level are
compacted into one of the next.  As batches share no document, numbers add up and the first largest doc_id stays.

The runs then judge the lines of all documents: a line goes if its key is held often enough and by a larger doc_id.
Keys that stand in more than a 4096th of a batch's lines, at most 4096 a batch by count, are judged by a broadcast; all
others, in a merge join, have no large group.  Only hashes move; texts move once, to meet the hashes they lose.

Edge cases.  Null text counts as empty: one empty line.  Documents are told apart by doc_id: rows that share one count as
one document (each row is returned, with its own lines), and rows without one count as one document below all others.
Keys shorter than ``LEAST_POINTS`` code points are never dropped.  A line repeated in the document that keeps it stays as
often as it stands there.  Texts of any length are split whole.  Empty tables give no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, give_back, light_batches, remove, shared_dir

LEAST_POINTS = 20
LEAST_DOCUMENTS = 3
BATCHES = 6
FANOUT = 3
HEAVY_SHARE = 4096
WHITE = b" \t\n\x0b\x0c\r"
RUN = "key binary, docs long, top long"
FEW_BYTES = 4 * LEAST_POINTS


def line_key(line: bytes) -> bytes | None:
    """The hash of a line's key; None for keys that are too short."""
    key = line.strip(WHITE).lower()
    if len(key) < LEAST_POINTS or (len(key) < FEW_BYTES and not key.isascii() and len(key.decode()) < LEAST_POINTS):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = {line_key(x) for x in (text or "").encode().split(b"\n")} - {None}
            docs += [doc] * len(own)
            keys += own
        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])
    give_back()


def line_entries(docs: DataFrame) -> DataFrame:
    """The keys of each row of ``docs(doc_id, text)``, each once: doc_id, key."""
    return docs.mapInArrow(_entries, "doc_id long, key binary")


class LineRuns:
    """Levelled sorted runs of line keys under ``folder``, each with key, docs and top (the largest doc_id)."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, enough: int = LEAST_DOCUMENTS):
        self.spark, self.folder, self.fanout, self.enough = spark, folder, fanout, enough
        self.levels: list[list[str]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def _merged(self, paths: list[str]) -> DataFrame:
        rows = self._read(paths)
        return rows if len(paths) < 2 else rows.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def merged(self) -> DataFrame:
        """All runs as one: every key once."""
        return self._merged([path for level in self.levels for path in level])

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/{level}-{uuid.uuid4().hex}"
        rows.select("key", "docs", "top").sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, own: DataFrame) -> None:
        """Take a batch's own keys (key, docs, top); its documents come after all those of the batches before it."""
        if self.levels:
            known = self.merged().where(F.col("docs") >= self.enough).select("key")
            own = own.join(known.hint("merge"), "key", "left_anti")
        self._write(own, 0)
        for level, paths in enumerate(self.levels):
            if len(paths) >= self.fanout:
                self._write(self._merged(paths), level + 1)
                self.levels[level] = []
                for path in paths:
                    remove(self.spark, path)


def _batch_of(cuts: set[int]) -> Column:
    """The batch of a doc_id: the number of cuts that it is not above, so 0 for the largest and the last for null."""
    return sum((F.coalesce(F.col("doc_id") <= cut, F.lit(True)).cast("int") for cut in cuts), F.lit(0))


def dropped_keys(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The keys that documents of ``docs(doc_id, text)`` lose: doc_id, gone (array of hashes), checkpointed."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    line_entries(docs).write.parquet(f"{folder}/entries")
    entries = spark.read.schema("doc_id long, key binary").parquet(f"{folder}/entries")

    cuts = entries.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or [] if batches > 1 else []
    cuts = set(cuts)
    numbered = entries.distinct().withColumn("batch", _batch_of(cuts))
    own = numbered.groupBy("batch", "key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top"))
    own.sortWithinPartitions("batch", "key").write.partitionBy("batch").parquet(f"{folder}/own")
    own = spark.read.schema(RUN + ", batch int").parquet(f"{folder}/own")

    runs = LineRuns(spark, f"{folder}/runs", fanout)
    for k in range(len(cuts) + 1):
        runs.add(own.where(F.col("batch") == k).drop("batch"))
    repeated = runs.merged().where(F.col("docs") >= LEAST_DOCUMENTS).select("key", "top")
    repeated.write.parquet(f"{folder}/repeated")
    repeated = spark.read.schema("key binary, top long").parquet(f"{folder}/repeated")

    sizes = own.groupBy("batch").agg(F.sum("docs").alias("lines"))  # one row a batch
    heavy = own.join(F.broadcast(sizes), "batch").where(F.col("docs") * HEAVY_SHARE > F.col("lines")).select("key").distinct()
    lost = ~F.col("doc_id").eqNullSafe(F.col("top"))
    hot = entries.join(F.broadcast(repeated.join(F.broadcast(heavy), "key", "left_semi")), "key").where(lost)
    rest = entries.join(F.broadcast(heavy), "key", "left_anti").join(repeated.hint("merge"), "key").where(lost)
    gone = checkpoint(hot.union(rest).groupBy("doc_id").agg(F.collect_set("key").alias("gone")))
    remove(spark, folder)
    return gone


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, texts = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            text = text or ""
            if not gone:
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                texts.append(text)
                continue
            lines, gone = text.encode().split(b"\n"), set(gone)
            kept = [x for x in lines if line_key(x) not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            texts.append(b"\n".join(kept).decode())
        yield pa.record_batch([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])
    give_back()


def deduplicate(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_lines (before), n_dropped and the text that stays."""
    docs = light_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = dropped_keys(docs, batches, fanout).withColumnRenamed("doc_id", "loser")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("loser")), "left").select("doc_id", "text", "gone").mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, text string")


def line_digests(docs: DataFrame) -> DataFrame:
    """``deduplicate`` with the kept text's SHA-256 in its place."""
    return deduplicate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (
  SELECT key, max(doc_id) AS top FROM (SELECT DISTINCT doc_id, key FROM keyed WHERE length(key) >= 20)
  GROUP BY key HAVING count(*) >= 3
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (top IS NOT NULL AND k.doc_id IS DISTINCT FROM top) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (top IS NULL OR k.doc_id IS NOT DISTINCT FROM top), '')) AS kept_sha256
FROM keyed k LEFT JOIN held h ON k.key = h.key
GROUP BY k.r, k.doc_id
"""
