"""Exact top-k by integer inner product on a bit-sliced index.

Components become floor(1024 x).  A block of rows keeps, for each dimension, bitmaps of the value's slices (bit k of
every row).  The query's weighted sum of slices is added up for all rows at once with bitmap arithmetic (carry-save
adders over whole bitmaps, for many queries together), on the leading ``SLICES`` bits of each value.  From the most
significant slice of the sum downward, the k-th largest sum of each query is found by bitmap counts; the bits left out
bound how far a row's exact score can be from its sum, so every row that may belong to the top is selected by one more
comparison over slices, and these boundary rows are resolved exactly on the integers.

Rows are dealt into blocks by hash, once; each block is indexed where it lies, and all queries stream past it in
bounded batches.  A block returns at most k rows a query; a window keeps the k best.

Edge cases.  Vectors that are null, empty or hold null or non-finite components take no part.  Vectors of different
lengths do not meet.  A query meets every row but those with its own vec_id.  Ties go to the smaller vec_id.  Rows with
a null vec_id take no part.  With fewer than k candidates all are returned.  Components may be of any finite size:
vectors whose products might leave 64 bits are scored with unbounded integers beside the bitmaps, and a score beyond 64
bits counts as the nearest 64-bit number.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import beside, give_back, matrix

SCALE = 1024
K = 10
QUERY_MOD = 100
SLICES = 6
ROW_BLOCK = 1 << 15
BITMAP_WORDS = 1 << 17  # words of a bitmap of all queries of a batch


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats as they are, all else as doubles) and dim of the rows whose components are all finite."""
    x = F.col("embedding")
    x = x if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else x.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    ok = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ok).withColumn("dim", F.size("embedding"))


class Columns:
    """Bitmaps by weight; three of one weight are at once replaced by their sum and carry."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = []

    def add(self, weight: int, bits: np.ndarray) -> None:
        while True:
            while len(self.held) <= weight:
                self.held.append([])
            column = self.held[weight]
            if len(column) < 2:
                column.append(bits)
                return
            b, a = column.pop(), column.pop()
            half = a ^ b
            column.append(half ^ bits)
            bits = (a & b) | (half & bits)
            weight += 1

    def sum(self) -> list[np.ndarray]:
        """One bitmap a weight: the remaining pairs added by ripple carry."""
        out, weight, carry = [], 0, None
        while weight < len(self.held) or carry is not None:
            bits = (self.held[weight] if weight < len(self.held) else []) + ([] if carry is None else [carry])
            if not bits:
                out.append(None)
                carry = None
            elif len(bits) == 1:
                out.append(bits[0])
                carry = None
            elif len(bits) == 2:
                out.append(bits[0] ^ bits[1])
                carry = bits[0] & bits[1]
            else:
                half = bits[0] ^ bits[1]
                out.append(half ^ bits[2])
                carry = (bits[0] & bits[1]) | (half & bits[2])
            weight += 1
        return out


def _pack(bits: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


class Sliced:
    """The bit-sliced index of a block of rows; integers below ``bound(dim)`` in size."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, slices: int = SLICES):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.words = -(-len(ids) // 64)
        lifted = self.x - self.x.min(axis=0)
        top = int(lifted.max()).bit_length()
        self.drop = max(0, top - slices)
        lead, bits = lifted >> self.drop, max(0, top - self.drop)
        self.maps = [[_pack((lead[:, d] >> s & 1).astype(np.uint8), self.words) for s in range(bits)] for d in range(x.shape[1])]

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and exact scores of its best rows (at most k, ties to the smaller id)."""
        ids, x, drop, n, m, words = self.ids, self.x, self.drop, len(self.ids), len(query_ids), self.words
        own = np.searchsorted(ids, query_ids, side="right") - np.searchsorted(ids, query_ids)
        weight, ones = np.abs(q), np.full(words, ~np.uint64(0))
        columns = Columns()
        everyone = np.uint64(0xFFFFFFFFFFFFFFFF)
        for d, maps in enumerate(self.maps):
            flip = np.where(q[:, d] < 0, everyone, np.uint64(0))[:, None]  # a negative weight adds |w| (full - value)
            signed = [(bits[None, :] & ones) ^ flip for bits in maps]
            for j in range(int(weight[:, d].max()).bit_length()):
                pick = np.where(weight[:, d] >> j & 1, everyone, np.uint64(0))[:, None]
                for s, bits in enumerate(signed):
                    columns.add(j + s, bits & pick)
        sums = columns.sum()
        # Each exact score lies within ``width`` above (sum << drop) plus a number of the query.
        width = (weight.sum(axis=1) * ((1 << drop) - 1)).tolist()
        alive = _pack(np.ones(n, np.uint8), words)[None, :].repeat(m, axis=0)
        want = np.minimum(k + own, n)
        best, inside = np.zeros((m, words), np.uint64), alive.copy()
        kth = np.zeros(m, object)
        for s in range(len(sums) - 1, -1, -1):
            bits = sums[s]
            if bits is None:
                continue
            got = inside & bits
            enough = np.bitwise_count(best | got).sum(axis=1) >= want
            kth = kth + np.where(enough, 1 << s, 0).astype(object)
            best = np.where(enough[:, None], best, best | got)
            inside = np.where(enough[:, None], got, inside & ~bits)
        least = [max(0, -(-((int(v) << drop) - w) >> drop)) if drop else int(v) for v, w in zip(kth, width, strict=True)]
        above, equal = np.zeros((m, words), np.uint64), alive.copy()
        for s in range(len(sums) - 1, -1, -1):
            bits = sums[s] if sums[s] is not None else np.zeros((m, words), np.uint64)
            set_ = np.array([v >> s & 1 for v in least], bool)[:, None]
            above = np.where(set_, above, above | (equal & bits))
            equal = np.where(set_, equal & bits, equal & ~bits)
        may = above | equal
        out = []
        for i in range(m):
            rows = np.flatnonzero(np.unpackbits(may[i].view(np.uint8), count=n, bitorder="little"))
            rows = rows[ids[rows] != query_ids[i]]
            score = x[rows] @ q[i]
            first = np.lexsort((ids[rows], -score))[:k]
            out.append((ids[rows[first]], score[first]))
        return out


def top_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int = K, slices: int = SLICES) -> list[tuple[np.ndarray, np.ndarray]]:
    """``Sliced.top`` of one block."""
    return Sliced(ids, x, slices).top(query_ids, q, k)


def bound(dim: int) -> int:
    """Components below it in size have inner products that fit 64 bits by far."""
    return math.isqrt((1 << 60) // dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) as unbounded integers."""
    return np.array([[int(c) * SCALE if abs(c) > 1e300 else math.floor(c * SCALE) for c in row] for row in x.tolist()], object).reshape(x.shape)


class Block:
    """Rows of one length: those with small components sliced, the others as unbounded integers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, slices: int):
        self.dim, x = x.shape[1], x.astype(np.float64)
        self.huge = (np.abs(x) >= bound(self.dim) // SCALE - 1).any(axis=1)
        self.sliced = Sliced(ids[~self.huge], np.floor(x[~self.huge] * SCALE).astype(np.int64), slices) if not self.huge.all() else None
        self.ids, self.x = ids, x

    def _exact(self, query_id: int, q: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[int]]:
        rows = rows[self.ids[rows] != query_id]
        score = _scaled(self.x[rows]) @ _scaled(q[None, :])[0] if len(rows) else np.zeros(0, object)
        return self.ids[rows].tolist(), [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score]

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[int]]]:
        """(query id, ids, scores) of each query's best rows."""
        q = q.astype(np.float64)
        large = (np.abs(q) >= bound(self.dim) // SCALE - 1).any(axis=1)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        small = np.flatnonzero(~large)
        if self.sliced and len(small):
            size = max(8, BITMAP_WORDS // self.sliced.words)
            for a in range(0, len(small), size):
                part = small[a : a + size]
                got = self.sliced.top(query_ids[part], np.floor(q[part] * SCALE).astype(np.int64), k)
                found |= dict(zip(part.tolist(), got, strict=True))
        for i, query_id in enumerate(query_ids.tolist()):
            ids, scores = (v.tolist() for v in found[i]) if i in found else ([], [])
            rest = np.arange(len(self.ids)) if large[i] else np.flatnonzero(self.huge)
            if len(rest):
                more = self._exact(query_id, q[i], rest)
                order = sorted(zip([-s for s in scores + more[1]], ids + more[0], strict=True))[:k]
                ids, scores = [v for _, v in order], [-s for s, _ in order]
            yield query_id, ids, scores


def by_length(held: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, matrix) for each length of vectors among the batches."""
    if held:
        rows = pa.Table.from_batches(held)
        for dim in np.unique(rows["dim"].to_numpy()).tolist():
            part = rows.filter(pa.compute.equal(rows["dim"], dim))
            yield dim, part["vec_id"].to_numpy(), matrix(part["embedding"])


def met(index, answers, score_type: pa.DataType):
    """A function over partitions of ``beside``: ``index(ids, x)`` of a block's rows by length, then of each batch of
    queries ``answers(indexed, query_ids, q)``, which gives (query_id, ids, scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks = [], None
        for batch in batches:
            asks = batch.column("asks")
            rows = batch.filter(pa.compute.invert(asks))
            if rows.num_rows:
                held.append(rows)
            asked = batch.filter(asks)
            if not asked.num_rows:
                continue
            if blocks is None:  # rows come before all queries
                blocks = {dim: index(ids, x) for dim, ids, x in by_length(held)}
                held = []
            for dim, ids, x in by_length([asked]):
                if dim in blocks:
                    found = list(answers(blocks[dim], ids, x))
                    cols = [np.repeat([i for i, _, _ in found], [len(v) for _, v, _ in found]).astype(np.int64), np.concatenate([np.asarray(v, np.int64) for _, v, _ in found])]
                    yield pa.record_batch([*map(pa.array, cols), pa.array(np.concatenate([s for _, _, s in found]), score_type)], names=["query_id", "vec_id", "score"])
        held, blocks = [], None
        give_back()

    return run


def ranked(found: DataFrame, k: int, order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = K, query_mod: int = QUERY_MOD, slices: int = SLICES) -> DataFrame:
    """Queries are rows of ``vectors(vec_id, embedding)`` whose vec_id is divisible by ``query_mod``.

    Returns query_id, rank (from 1), vec_id and the integer score.
    """
    rows = valid_vectors(vectors)
    run = met(lambda ids, x: Block(ids, x, slices), lambda block, ids, q: block.top(ids, q, k), pa.int64())
    found = beside(rows, rows.where(F.col("vec_id") % query_mod == 0), ROW_BLOCK).mapInArrow(run, "query_id long, vec_id long, score long")
    return ranked(found, k, F.desc("score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS value
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.value, v.value), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.value) = len(q.value) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
