"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

A table rotates unit vectors by rounds of random signs and a fast Hadamard transform, twice (``HASHES``); a vector's
code is the pair of nearest signed axes of the rotated vectors (the position of the largest absolute entry, with the
sign).  A query visits a table's codes in the order of its summed projections on their axes, until they hold the rows
that the table may contribute: ``VISIT * n ** 0.7`` of n rows, ``LEAST`` at least.  The distinct rows met in all tables
are its candidates, ranked exactly on the original vectors.

Rows are dealt into blocks by hash, once; a block keeps its own tables, and all queries stream past it, each with the
block's share of the rows to visit.  So a code that holds a third of all rows is spread over all blocks, and no row is
copied for another table.  The first ``PROBES`` codes are looked up; where they hold too few rows, the block's occupied
codes are ranked instead, and a query that still meets fewer than ``k`` other ids of a block visits all its rows.  So
it gets ``k`` rows, or all candidates if there are fewer.

The exponent follows from the theory of such codes (see the README for the recall and visits measured): the share of
the rows that is visited falls as n grows.

Edge cases.  Vectors that are null, empty, zero, or hold null or non-finite components take no part.  Vectors of
different lengths do not meet.  A query meets every row but those with its own vec_id; ties go to the smaller vec_id; a
vec_id that occurs twice counts by its nearest row.  Rows with a null vec_id take no part.  Vectors whose squares leave
the double range get an infinite or zero distance, as the measure has it.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bit_topk import K, QUERY_MOD, met, ranked, valid_vectors
from .common import beside

TABLES = 32
HASHES = 2
PROBES = 96
VISIT, POWER, LEAST = 0.1, 0.7, 8
ROW_BLOCK = 1 << 18
HASH_ROWS = 1 << 13


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    x, other, step = x.copy(), np.empty_like(x), 1
    while step < d:
        a, b = x.reshape(n, -1, 2, step), other.reshape(n, -1, 2, step)
        np.add(a[:, :, 0], a[:, :, 1], out=b[:, :, 0])
        np.subtract(a[:, :, 0], a[:, :, 1], out=b[:, :, 1])
        x, other, step = other, x, 2 * step
    x *= x.dtype.type(1 / np.sqrt(d))
    return x


def room(dim: int) -> int:
    """The dimension of the rotated vectors, a power of two."""
    return 1 << max(1, int(dim - 1).bit_length())


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, padded to ``room``; scaled first, so that no square leaves the range."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    out = np.zeros((len(x), room(x.shape[1])), np.float32)
    out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def rotated(unit: np.ndarray, table: int, h: int) -> np.ndarray:
    """One pseudo-rotation: three rounds of random signs and the transform."""
    r, d = np.random.Generator(np.random.PCG64([table, h, unit.shape[1]])), unit.shape[1]
    for _ in range(3):
        unit = hadamard(unit * r.choice(np.array((-1, 1), np.float32), d))
    return unit


def codes(unit: np.ndarray, table: int, hashes: int = HASHES) -> np.ndarray:
    """The code of each row's nearest signed axes."""
    code = np.zeros(len(unit), np.int64)
    for h in range(hashes):
        y = rotated(unit, table, h)
        axis = np.abs(y).argmax(axis=1)
        code = code * (2 * y.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
    return code


def projections(unit: np.ndarray, table: int, hashes: int = HASHES) -> list[np.ndarray]:
    """For each hash the projection on axis a with sign s, at 2 a + s."""
    return [np.stack([y, -y], axis=2).reshape(len(y), -1) for y in (rotated(unit, table, h) for h in range(hashes))]


def probed(near: list[np.ndarray], probes: int = PROBES) -> np.ndarray:
    """For each row the ``probes`` codes with the largest summed projections, largest first."""
    total = code = None
    for y in near:
        first = np.argsort(-y, axis=1, kind="stable")[:, : min(probes, y.shape[1])]
        value = np.take_along_axis(y, first, axis=1)
        if code is None:
            total, code = value, first.astype(np.int64)
            continue
        # Of two falling lists, the sum at places (i, j) has (i + 1)(j + 1) - 1 others before it.
        i, j = np.nonzero((np.arange(total.shape[1])[:, None] + 1) * (np.arange(value.shape[1])[None, :] + 1) <= probes)
        total, code = total[:, i] + value[:, j], code[:, i] * y.shape[1] + first[:, j]
        keep = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        total, code = np.take_along_axis(total, keep, axis=1), np.take_along_axis(code, keep, axis=1)
    return code


def nearest(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int, repeated: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids with their Euclidean distances, ties to the smaller id, the query's own id left out."""
    other = np.flatnonzero(ids != query_id)
    if len(other) > 2 * k and not repeated:
        # A first cut by |x|^2 - 2 x q keeps all within rounding of the k-th; the distances themselves decide.
        with np.errstate(over="ignore", invalid="ignore"):
            rough = np.einsum("ij,ij->i", x[other], x[other]) - 2 * (x[other] @ q)
            edge = np.partition(rough, k - 1)[k - 1] + 1e-9 * max(1.0, float(np.abs(rough).max()), float(q @ q))
        if np.isfinite(edge):  # else squares leave the double range, and all rows are measured
            other = other[rough <= edge]
    with np.errstate(over="ignore"):
        distance = np.sqrt(((x[other] - q) ** 2).sum(axis=1))
    order = np.lexsort((ids[other], distance))
    if repeated:  # an id counts by its nearest row
        order = order[np.sort(np.unique(ids[other[order]], return_index=True)[1])]
    order = order[:k]
    return ids[other[order]], distance[order]


class Tables:
    """A block's rows of one length under their codes in every table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES):
        self.ids, self.x, self.tables, self.hashes, self.probes = ids, x, tables, hashes, probes
        self.repeated = len(np.unique(ids)) < len(ids)
        self.axes = 2 * room(x.shape[1])
        n, self.codes, self.starts = len(x), [], []
        self.order = np.empty((tables, n), np.int32)
        code = np.empty((tables, n), np.int64)
        for a in range(0, n, HASH_ROWS):
            unit = units(x[a : a + HASH_ROWS])
            for t in range(tables):
                code[t, a : a + HASH_ROWS] = codes(unit, t, hashes)
        for t in range(tables):
            self.order[t] = np.argsort(code[t], kind="stable")
            sorted_ = code[t, self.order[t]]
            at = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            self.codes.append(sorted_[at])
            self.starts.append(np.append(at, n))

    def _visited(self, t: int, near: np.ndarray, sums: list[np.ndarray], least: int) -> np.ndarray:
        """The rows under the codes that a query visits in one table: the nearest codes that hold ``least`` rows."""
        known, starts = self.codes[t], self.starts[t]
        j = np.minimum(np.searchsorted(known, near), len(known) - 1)
        j = j[known[j] == near]
        if (starts[j + 1] - starts[j]).sum() < least:  # rank the occupied codes themselves
            value, rest = np.zeros(len(known), np.float32), known
            for y in reversed(sums):
                value += y[rest % self.axes]
                rest = rest // self.axes
            j = np.argsort(-value, kind="stable")
        size = starts[j + 1] - starts[j]
        j = j[: np.searchsorted(np.cumsum(size), least) + 1]
        return np.concatenate([self.order[t, starts[i] : starts[i + 1]] for i in j.tolist()])

    def candidates(self, q: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the distinct rows that it visits, each table contributing ``least`` of them or all."""
        unit, least = units(q), min(least, len(self.ids))
        sums = [projections(unit, t, self.hashes) for t in range(self.tables)]
        near = [probed(s, self.probes) for s in sums]
        for i in range(len(q)):
            seen = np.zeros(len(self.ids), bool)
            for t in range(self.tables):
                seen[self._visited(t, near[t][i], [s[i] for s in sums[t]], least)] = True
            yield np.flatnonzero(seen)

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, distances) of each query's nearest rows found."""
        for a in range(0, len(q), 256):
            part, ids = q[a : a + 256].astype(np.float64), query_ids[a : a + 256]
            for query_id, v, rows in zip(ids.tolist(), part, self.candidates(part, least), strict=True):
                got = nearest(self.ids[rows], self.x[rows].astype(np.float64), query_id, v, k, self.repeated)
                if len(got[0]) < k and len(rows) < len(self.ids):
                    got = nearest(self.ids, self.x.astype(np.float64), query_id, v, k, self.repeated)
                yield query_id, *got


def to_visit(n: int, visit: float = VISIT, power: float = POWER, least: int = LEAST) -> int:
    """How many of n rows a query visits in each table."""
    return max(least, int(np.ceil(visit * n**power)))


def search(vectors: DataFrame, k: int = K, query_mod: int = QUERY_MOD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, visit: float = VISIT) -> DataFrame:
    """Queries are rows of ``vectors(vec_id, embedding)`` whose vec_id is divisible by ``query_mod``.

    Returns query_id, rank (from 1), vec_id and score, the Euclidean distance in double precision.
    """
    rows = valid_vectors(vectors).where(F.exists("embedding", lambda c: c != 0))
    n = max(1, rows.count())
    share = to_visit(n, visit) / n

    def answers(block: Tables, ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return block.nearest(ids, q, k, max(1, int(np.ceil(share * len(block.ids)))))

    run = met(lambda ids, x: Tables(ids, x, tables, hashes, probes), answers, pa.float64())
    found = beside(rows, rows.where(F.col("vec_id") % query_mod == 0), ROW_BLOCK).mapInArrow(run, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return ranked(once, k, "score")
