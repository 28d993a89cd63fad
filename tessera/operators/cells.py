"""A clustered vector index: search by cosine that reads the cells near a query, not all vectors.

Unit vectors belong to the nearest of some centres (k-means, trained on a bounded sample; every vector is indexed).  A
cell keeps for each vector its residual in 8-bit steps and how far that lies from the vector itself, so a score is known
within that distance.  Cells are sorted into files by number, some cells a file.

A search scores codes in the nearest cells, keeps what can still be among the best k, and computes those exactly from the
vectors.  With ``exact`` it then visits every cell that may hold a better one: no vector of a cell is nearer to a query than
the centre's distance less the cell's radius.  So the result is that of a scan, however the vectors lie; how much is read
depends on how well they cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from . import retrieval

#: Vectors that centres are trained on, for each centre and at most; bounds of the sample, not of the index.
SAMPLE_EACH, SAMPLE_MOST = 64, 200_000
MOST_CELLS = 1 << 14
ROUNDS = 5
#: Rows of a cell that one task scores; larger cells are dealt out.
PIECE_ROWS = 1 << 16
#: Files that the cells are dealt to: at most this many folders.
MOST_GROUPS = 512
SLACK = 1e-6


@dataclass
class CellIndex:
    """``codes`` (cell, piece, key, code, scale, miss), grouped by ``part``; ``centres``; ``cells`` (cell, part, pieces, rows,
    radius)."""

    codes: DataFrame
    cells: DataFrame
    centres: np.ndarray
    key: str


def matrix(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def unit_rows(points: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, unit): vectors at length one; null and zero vectors, and those with missing or infinite parts, are left out."""
    x = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    rows = points.select(key, x.alias("x"), length.alias("length")).where("length > 0 and length < double('infinity')")
    return rows.select(key, F.transform("x", lambda v: v / F.col("length")).alias("unit"))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T * 2 - (centres * centres).sum(axis=1)).argmax(axis=1)


def train(units: DataFrame, n: int, count: int, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means over a sample of the units, by hash: each round sums the vectors of each centre in the tasks and
    then over them."""
    share = min(1.0, min(SAMPLE_MOST, SAMPLE_EACH * count) / max(1, n))
    key = units.columns[0]
    sample = checkpointed(units.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.xxhash64(key).alias("h"), "unit"))
    first = sample.orderBy("h").limit(count).select("unit").toArrow()
    centres = matrix(first["unit"]) if first.num_rows else np.zeros((1, dim))
    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("unit"))
                    cell = nearest(x, centres)
                    np.add.at(sums, cell, x)
                    counts += np.bincount(cell, minlength=len(centres))
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(some), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.float64()))], names=["cell", "n", "sum"])

        parts = sample.select("unit").mapInArrow(summed, "cell long, n long, sum array<double>")
        total = parts.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.col("sum")[i]).alias(f"s{i}") for i in range(dim))).toArrow()
        moved = np.stack([total[f"s{i}"].to_numpy() for i in range(dim)], axis=1) / total["n"].to_numpy()[:, None]
        new = centres.copy()  # a centre without vectors stays where it is
        new[total["cell"].to_numpy()] = moved
        if np.allclose(new, centres, atol=1e-7):
            break
        centres = new
    return centres


def cells_for(n: int) -> int:
    return max(1, min(MOST_CELLS, round(2 * math.sqrt(n))))


def build(points: DataFrame, path: str, key: str = "chunk_id", count: int | None = None) -> str:
    """Index ``points(key, vector)``, vectors of one length, under ``path``."""
    spark = points.sparkSession
    units = checkpointed(unit_rows(points, key))
    n = units.count()
    dims = [r.d for r in units.select(F.size("unit").alias("d")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError("the vectors differ in length")
    centres = train(units, n, count or cells_for(n), dims[0] if dims else 1)
    groups = max(1, min(MOST_GROUPS, len(centres)))
    kind = points.schema[key].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("unit"))
            cell = nearest(x, centres)
            rest = x - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-30)
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            miss = np.linalg.norm(rest - code * scale[:, None], axis=1)
            away = np.linalg.norm(rest, axis=1)
            yield pa.record_batch([pa.array(cell), batch.column(key), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(miss), pa.array(away)], names=["cell", key, "code", "scale", "miss", "away"])

    rows = checkpointed(units.mapInArrow(coded, f"cell long, `{key}` {kind}, code binary, scale double, miss double, away double"))
    cells = checkpointed(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius")))
    cells = cells.withColumn("pieces", F.ceil(F.col("rows") / PIECE_ROWS).cast("int")).withColumn("part", F.expr(f"cast(cell * {groups}L div {len(centres)}L as int)"))
    dealt = rows.join(F.broadcast(cells.select("cell", "pieces", "part")), "cell").withColumn("piece", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int"))  # at most MOST_CELLS rows
    dealt.select("cell", "piece", key, "code", "scale", "miss", "part").repartition("part", "piece").sortWithinPartitions("part", "cell").write.partitionBy("part").parquet(f"{path}/codes")
    cells.write.parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell long, centre array<double>").write.parquet(f"{path}/centres")
    return path


def read(spark: SparkSession, path: str, key: str = "chunk_id", kind: str = "string") -> CellIndex:
    codes = spark.read.schema(f"cell long, piece int, `{key}` {kind}, code binary, scale double, miss double, part int").parquet(f"{path}/codes")
    cells = spark.read.schema("cell long, rows long, radius double, pieces int, part int").parquet(f"{path}/cells")
    return CellIndex(codes, cells, matrix(spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()["centre"]), key)


def _probes(centres: np.ndarray, radius: np.ndarray, count: int | None):
    """(query_id, cell, q, most) for unit queries: the ``count`` nearest cells that have rows, or all of them; ``most`` is
    the greatest cosine that the cell can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.flatnonzero(~np.isnan(radius))
        for batch in batches:
            if not batch.num_rows or not len(there):
                continue
            q = matrix(batch.column("unit"))
            away = np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] + (centres[there] ** 2).sum(axis=1) - 2 * q @ centres[there].T))
            least = np.maximum(0, away - radius[there])
            k = len(there) if count is None else min(count, len(there))
            best = np.argsort(away, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(q)), k)
            cell = best.reshape(-1)
            most = 1 - least[row, cell] ** 2 / 2
            yield pa.record_batch([batch.column("query_id").take(pa.array(row)), pa.array(there[cell]), batch.column("unit").take(pa.array(row)), pa.array(most)], names=["query_id", "cell", "unit", "most"])

    return run


def _scored(centres: np.ndarray, k: int, key: str):
    """Each query's candidates of one piece of a cell: all that may be among its best k there."""

    def run(asked: pa.Table, codes: pa.Table) -> pa.Table:
        if not asked.num_rows or not codes.num_rows:
            return pa.table([asked["query_id"][:0], codes[key][:0], pa.array([], pa.float64()), pa.array([], pa.float64())], names=["query_id", key, "low", "high"])
        q, cell = matrix(asked["unit"]), asked["cell"][0].as_py()
        code = np.frombuffer(b"".join(codes["code"].to_pylist()), np.int8).reshape(codes.num_rows, -1)
        scale, miss = codes["scale"].to_numpy(), codes["miss"].to_numpy()
        score = (q @ centres[cell])[:, None] + (q @ code.T.astype(np.float64)) * scale
        low, high = score - miss, score + miss
        floor = -np.partition(-low, min(k, low.shape[1]) - 1, axis=1)[:, min(k, low.shape[1]) - 1]
        i, j = np.nonzero(high >= floor[:, None] - SLACK)
        return pa.table([asked["query_id"].take(pa.array(i)), codes[key].take(pa.array(j)), pa.array(low[i, j]), pa.array(high[i, j])], names=["query_id", key, "low", "high"])

    return run


def candidates(asked: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """(query_id, key, low, high) of ``asked(query_id, cell, unit)``: what the cells asked for may put among the best k, with
    bounds of the cosine."""
    parts = [r.part for r in index.cells.join(asked.select("cell").distinct(), "cell", "left_semi").select("part").distinct().collect()]  # at most MOST_GROUPS
    dealt = asked.join(F.broadcast(index.cells.select("cell", "pieces")), "cell").select("query_id", "cell", "unit", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    codes = index.codes.where(F.col("part").isin(parts)).drop("part").join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")  # at most MOST_CELLS rows
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, `{index.key}` {index.codes.schema[index.key].dataType.simpleString()}, low double, high double"
    return dealt.groupBy("cell", "piece").cogroup(codes.groupBy("cell", "piece")).applyInArrow(_scored(index.centres, k, index.key), kinds)


def _floors(found: DataFrame, k: int) -> DataFrame:
    """The k-th greatest lower bound of each query that has k: no row below it is among the best k."""
    return retrieval.top(found, k, F.desc("low")).groupBy("query_id").agg(F.min("low").alias("floor"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("floor")).otherwise(F.lit(-2.0)).alias("floor"))


def search(queries: DataFrame, index: CellIndex, points: DataFrame, k: int = retrieval.DENSE_K, probes: int = 8, exact: bool = False) -> DataFrame:
    """Top k by cosine of ``queries(query_id, vector)`` over the indexed ``points(key, vector)``: query_id, key, score, rank."""
    return retrieval.top(rescored(survivors(queries, index, k, probes, exact), queries, points, index.key), k, F.desc("score"), index.key)


def survivors(queries: DataFrame, index: CellIndex, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """(query_id, key): what may be among the best k of each of ``queries(query_id, vector)``.

    ``probes`` cells are visited for each query; with ``exact`` also all others that may hold one of the best k.
    """
    key = index.key
    asked = checkpointed(unit_rows(queries, "query_id"))
    radius = np.full(len(index.centres), np.nan)
    for r in index.cells.select("cell", "radius").collect():  # at most MOST_CELLS
        radius[r.cell] = r.radius
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, cell long, unit array<double>, most double"
    near = checkpointed(asked.mapInArrow(_probes(index.centres, radius, probes), kinds))
    found = checkpointed(candidates(near, index, k))
    if exact:
        floors = checkpointed(asked.select("query_id").join(_floors(found, k), "query_id", "left").select("query_id", F.coalesce("floor", F.lit(-2.0)).alias("floor")))
        rest = asked.mapInArrow(_probes(index.centres, radius, None), kinds).join(near.select("query_id", "cell"), ["query_id", "cell"], "left_anti")
        rest = checkpointed(rest.join(floors, "query_id").where(F.col("most") >= F.col("floor") - SLACK).drop("floor"))
        found = checkpointed(found.union(candidates(rest, index, k)))
    return found.join(_floors(found, k), "query_id").where(F.col("high") >= F.col("floor") - SLACK).select("query_id", key)


def rescored(kept: DataFrame, queries: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score): the cosine of each of the pairs ``kept(query_id, key)``."""
    kind, query_kind = points.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, q = matrix(batch.column("x")), matrix(batch.column("q"))
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                q /= np.sqrt((q * q).sum(axis=1))[:, None]
                yield pa.record_batch([batch.column("query_id"), batch.column(key), pa.array(np.round((x * q).sum(axis=1), 9))], names=["query_id", key, "score"])

    both = points.select(key, F.col("vector").cast("array<double>").alias("x")).join(retrieval.small(kept), key)
    both = both.join(queries.select("query_id", F.col("vector").cast("array<double>").alias("q")), "query_id").where(F.size("x") == F.size("q"))
    return both.select("query_id", key, "x", "q").mapInArrow(cosines, f"query_id {query_kind}, `{key}` {kind}, score double")
