"""BM25 search that skips postings which cannot matter: blocks with greatest weights, and a threshold between rounds.

A term's postings in a bucket are stored in blocks of some units in order of their keys, each with its first and last key
and the greatest weight in it.  A search has three rounds:

1. each query's rarest terms are scored; the k-th best of these partial scores is the query's threshold;
2. terms whose greatest contributions together stay below the threshold bring no candidates.  Of all others, blocks are
   read that could lift a unit to the threshold, and units that could not reach it are dropped;
3. the terms left out are looked up for the remaining units alone, in the blocks whose keys enclose them.

No unit among the best k is lost, and all of those get their whole score, so the result is that of scoring everything.

``rounds`` are joins, a row for each posting of a query.  ``topk`` deals the blocks that some query needs by bucket, so that a
unit's blocks meet in one task, and does the last two rounds there in arrays; a task returns its best k of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from . import index as I
from . import retrieval
from .stored import BUCKETS, bucket_of

BLOCK_UNITS = 128
#: Units of a bucket, by which a large table has more of them.
BUCKET_UNITS = 20_000
#: A query's rarest terms, one at least, are scored in the first round while they have so many postings for each wanted unit.
LEAD_EACH = 20
SLACK = 1e-7


@dataclass
class BlockIndex:
    """``blocks(bucket, term, first, last, n, greatest, units)``, ``terms(term, df, greatest)`` and ``units(key)``."""

    blocks: DataFrame
    terms: DataFrame
    units: DataFrame
    key: str
    buckets: int


def write(units: DataFrame, path: str, key: str = "key", text: str = "text", buckets: int = BUCKETS, size: int = BLOCK_UNITS) -> str:
    """Index ``units(key, text)`` under ``path``."""
    spark = units.sparkSession
    rows = units.select(bucket_of(key, buckets=buckets).alias("bucket"), F.col(key).alias("k"), F.lower(text).alias("text"))
    kind = units.schema[key].dataType.simpleString()
    made = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "k").mapInArrow(_blocks_of(size), f"bucket int, term string, first {kind}, last {kind}, n long, greatest double, units array<struct<k:{kind},weight:double>>")
    made.sortWithinPartitions("bucket", "term", "first").write.partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("greatest").alias("greatest")).sort("term").write.parquet(f"{path}/terms")
    units.select(key).write.parquet(f"{path}/units")
    return path


def _blocks_of(size: int, most: int = 1 << 14):
    """Blocks of at most ``size`` postings of batches (bucket, k, lower-cased text) in order of buckets and keys: a bucket's postings
    are held as numbers and sorted at once."""

    def counted(rows: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The keys and terms of a slice, and of each posting its unit, term and weight."""
        terms, owner = I._split(rows)
        length = np.bincount(owner, minlength=rows.num_rows)
        coded = terms.dictionary_encode()
        many = max(1, len(coded.dictionary))
        at, tf = np.unique(owner.astype(np.int64) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        unit = at // many
        weight = tf * (retrieval.K1 + 1) / (tf + retrieval.K1 * ((1 - retrieval.B) + retrieval.B * length[unit] / retrieval.AVGDL))
        return rows.column("k"), coded.dictionary, unit.astype(np.int32), (at % many).astype(np.int32), weight

    def made(bucket: int, parts: list) -> Iterator[pa.RecordBatch]:
        keys, lists, unit, code, weight = zip(*parts, strict=True)
        base = np.cumsum([0, *map(len, keys)])
        unit = np.concatenate([u + b for u, b in zip(unit, base[:-1], strict=True)])
        shift = np.cumsum([0, *map(len, lists)])
        known = pa.concat_arrays(lists).dictionary_encode()
        rank = np.empty(len(known.dictionary), np.int64)
        by_rank = pc.sort_indices(known.dictionary)
        rank[by_rank.to_numpy()] = np.arange(len(rank))
        code = rank[known.indices.to_numpy(zero_copy_only=False)[np.concatenate([c + s for c, s in zip(code, shift[:-1], strict=True)])]]
        order = np.argsort(code * base[-1] + unit, kind="stable")
        code, unit, weight = code[order], unit[order], np.concatenate(weight)[order]
        if not len(code):
            return
        k, terms = pa.concat_arrays(keys), known.dictionary.take(by_rank)
        runs = np.concatenate(([0], 1 + np.flatnonzero(np.diff(code))))
        at = np.flatnonzero((np.arange(len(code)) - np.repeat(runs, np.diff(np.append(runs, len(code))))) % size == 0)
        greatest, ends = np.maximum.reduceat(weight, at), np.append(at, len(code))
        for x in range(0, len(at), most):
            e = ends[x : x + most + 1]
            head, own = e[:-1], slice(e[0], e[-1])
            units = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.StructArray.from_arrays([k.take(pa.array(unit[own])), pa.array(weight[own])], ["k", "weight"]))
            columns = [pa.array(np.full(len(head), bucket, np.int32)), terms.take(pa.array(code[head])), k.take(pa.array(unit[head])), k.take(pa.array(unit[e[1:] - 1])), pa.array(np.diff(e)), pa.array(greatest[x : x + most]), units]
            yield pa.record_batch(columns, names=["bucket", "term", "first", "last", "n", "greatest", "units"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = -1
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x:
                    if held and now != bucket[x]:
                        yield from made(now, held)
                        held = []
                    now = int(bucket[x])
                    held += [counted(rows) for rows in I.slices(batch.slice(x, y - x))]
        if held:
            yield from made(now, held)

    return run


def read(spark: SparkSession, path: str, key: str = "key", buckets: int = BUCKETS) -> BlockIndex:
    return BlockIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("blocks", "terms", "units")), key, buckets)


def weighted_terms(queries: DataFrame, index: BlockIndex) -> DataFrame:
    """(query_id, term, w, df, cap): a term's weight in a query, and the most that it can add to a score."""
    asked = retrieval.query_terms(queries)
    known = index.terms.join(retrieval.small(asked.select("term").distinct()), "term", "left_semi")
    total = index.units.agg(F.count(F.lit(1)).alias("n"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    rows = asked.join(known, "term").crossJoin(F.broadcast(total))
    return rows.select("query_id", "term", (F.col("query_weight") * idf).alias("w"), "df", (F.col("query_weight") * idf * F.col("greatest")).alias("cap"))


def _sums(blocks: DataFrame) -> DataFrame:
    """(query_id, k, score) of blocks joined with weighted terms."""
    each = blocks.select("query_id", "w", F.explode("units").alias("u")).select("query_id", "u.k", (F.col("w") * F.col("u.weight")).alias("part"))
    return each.groupBy("query_id", "k").agg(F.sum("part").alias("score"))


@dataclass
class Rounds:
    """What each round reads: ``lead`` and ``blocks`` are blocks with their queries, ``looked_up`` blocks by candidate."""

    lead: DataFrame
    blocks: DataFrame
    looked_up: DataFrame
    scores: DataFrame


def bounds(queries: DataFrame, index: BlockIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """The first round: its blocks with their queries, and each query's terms (query_id, term, w, cap, floor, all, idle, rest):
    ``floor`` is the threshold, ``idle`` terms bring no candidates, ``rest`` is the most that those add together."""
    weighted = checkpointed(weighted_terms(queries, index))
    by = Window.partitionBy("query_id")
    before = F.coalesce(F.sum("df").over(by.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = weighted.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("df") <= LEAD_EACH * k)).select("query_id", "term", "w")
    lead = index.blocks.join(retrieval.small(rare), "term")
    floors = retrieval.top(_sums(lead), k, F.desc("score")).groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = checkpointed(floors.select("query_id", F.when(F.col("n") >= k, F.col("floor") - SLACK).otherwise(F.lit(0.0)).alias("floor")))

    # Terms in order of what they can add: those whose sum stays below the threshold bring no candidates.
    caps = weighted.join(retrieval.small(floors), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    caps = caps.withColumns({"upto": F.sum("cap").over(by.orderBy("cap", "term").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("cap").over(by)})
    caps = checkpointed(caps.withColumn("idle", F.col("upto") < F.col("floor")))
    caps = caps.withColumn("rest", F.coalesce(F.max(F.when(F.col("idle"), F.col("upto"))).over(by), F.lit(0.0)))
    return lead, caps


def rounds(queries: DataFrame, index: BlockIndex, k: int) -> Rounds:
    lead, caps = bounds(queries, index, k)
    live = caps.where("not idle").select("query_id", "term", "w", "floor", "rest", (F.col("all") - F.col("cap")).alias("others"))
    blocks = index.blocks.join(retrieval.small(live), "term").where(F.col("w") * F.col("greatest") + F.col("others") >= F.col("floor"))
    limits = live.groupBy("query_id").agg(F.max("floor").alias("floor"), F.max("rest").alias("rest"))
    found = checkpointed(_sums(blocks).join(retrieval.small(limits), "query_id").where(F.col("score") + F.col("rest") >= F.col("floor")).select("query_id", "k", "score"))

    idle = caps.where("idle").select("query_id", "term", "w")
    open_ = found.select("query_id", "k", bucket_of("k", buckets=index.buckets).alias("bucket")).join(retrieval.small(idle), "query_id")
    looked_up = index.blocks.join(retrieval.small(open_), ["bucket", "term"]).where(F.col("k").between(F.col("first"), F.col("last")))
    hit = F.filter("units", lambda u: u["k"] == F.col("k"))
    more = looked_up.select("query_id", "k", F.explode(F.transform(hit, lambda u: u["weight"] * F.col("w"))).alias("score"))
    return Rounds(lead, blocks, looked_up, found.unionByName(more).groupBy("query_id", "k").agg(F.sum("score").alias("score")))


def topk(queries: DataFrame, index: BlockIndex, k: int = retrieval.SPARSE_K) -> DataFrame:
    """Top k by BM25: the rows of ``retrieval.stored_topk``.  Up to ``SMALL_ROWS`` weights go to all tasks; beyond, the rounds are
    joined."""
    caps = checkpointed(bounds(queries, index, k)[1].select("query_id", "term", "w", "floor", "idle", "rest", (F.col("all") - F.col("cap")).alias("others")))
    asked = caps.limit(retrieval.SMALL_ROWS + 1).toArrow().combine_chunks()
    if asked.num_rows > retrieval.SMALL_ROWS:
        scores = rounds(queries, index, k).scores.select("query_id", F.col("k").alias(index.key), F.round("score", 9).alias("score"))
        return retrieval.top(scores, k, F.desc("score"), index.key)
    # A block is needed if its greatest weight could lift a unit to the threshold of some query, or if some query may look it up.
    need = F.min(F.when(F.col("idle"), F.lit(0.0)).otherwise((F.col("floor") - F.col("others")) / F.col("w") - SLACK)).alias("need")
    terms = pc.unique(asked.column("term")).cast(pa.string())
    codes = index.blocks.sparkSession.createDataFrame(pa.table({"term": terms, "code": pa.array(np.arange(len(terms)), pa.int32())}))
    wanted = codes.join(F.broadcast(caps.groupBy("term").agg(need)), "term")
    dealt = index.blocks.join(F.broadcast(wanted), "term").where(F.col("greatest") >= F.col("need")).select("bucket", "code", "greatest", "units")
    dealt = dealt.repartition(index.buckets, "bucket").sortWithinPartitions("bucket", "code")
    kind = index.units.schema[index.key].dataType.simpleString()
    schema = f"query_id {caps.schema['query_id'].dataType.simpleString()}, `{index.key}` {kind}, score double"
    return retrieval.top(dealt.mapInArrow(_best_of_buckets(asked, terms, k, index.key), schema), k, F.desc("score"), index.key)


def _best_of_buckets(asked: pa.Table, terms: pa.Array, k: int, key: str):
    """Over blocks (bucket, code, greatest, units) in order of buckets and codes: the last two rounds, bucket by bucket."""
    code = pc.index_in(asked.column("term").combine_chunks().cast(terms.type), value_set=terms).to_numpy(zero_copy_only=False)
    coded = asked.column("query_id").combine_chunks().dictionary_encode()
    ids, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    w, floor, rest, others = (asked.column(c).to_numpy() for c in ("w", "floor", "rest", "others"))
    idle = asked.column("idle").to_numpy()
    order = np.argsort(of, kind="stable")
    own = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []

    def best(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        units = rows.column("units")
        size = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        each = units.flatten()
        met = each.field("k").dictionary_encode()
        keys, unit, weight = met.dictionary, met.indices.to_numpy(zero_copy_only=False), each.field("weight").to_numpy()
        place = np.empty(len(keys), np.int64)
        place[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        codes, greatest = rows.column("code").to_numpy(), rows.column("greatest").to_numpy()
        first, last = (np.searchsorted(codes, np.arange(len(terms)), side) for side in ("left", "right"))
        pairs = np.repeat(codes, size).astype(np.int64) * len(keys) + unit
        repeated = len(np.unique(pairs)) < len(pairs)  # rows with one key count together
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add(score: np.ndarray, i: int, most: float) -> None:
            """A term's postings, of blocks that can lift a unit to ``most``."""
            x, y = first[code[i]], last[code[i]]
            if x == y:
                return
            part = slice(ends[x] - size[x], ends[y - 1])
            at, what = unit[part], weight[part]
            fine = w[i] * greatest[x:y] + others[i] >= most
            if not fine.all():
                some = np.repeat(fine, size[x:y])
                at, what = at[some], what[some]
            if repeated:
                np.add.at(score, at, w[i] * what)
            else:
                score[at] += w[i] * what

        for mine in own:
            score = np.zeros(len(keys))
            for i in mine[~idle[mine]]:
                add(score, i, floor[i])
            most = floor[mine[0]]
            if len(score) > k:  # k units here have these scores at least
                most = max(most, np.partition(score, len(score) - k)[len(score) - k] - SLACK)
            open_ = np.flatnonzero((score > 0) & (score + rest[mine[0]] >= most))
            if not len(open_):
                continue
            for i in mine[idle[mine]]:
                add(score, i, -np.inf)
            got = np.round(score[open_], 9)
            if len(got) > k:
                fine = got >= np.partition(got, len(got) - k)[len(got) - k]
                open_, got = open_[fine], got[fine]
            chosen = np.lexsort((place[open_], -got))[:k]
            out.append((np.full(len(chosen), of[mine[0]]), open_[chosen], got[chosen]))
        if not out:
            return None
        query, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.record_batch([ids.take(pa.array(query)), keys.take(pa.array(at)), pa.array(score)], names=["query_id", key, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held and (found := best(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
                yield found
            held.clear()

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x:
                    if held and held[0].column("bucket")[0].as_py() != bucket[x]:
                        yield from done()
                    held.append(batch.slice(x, y - x))
        yield from done()

    return run
