"""Shared pieces of the training-data operators: session helpers and vectorised text hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: A text slice handed to the vectorised code holds about this many bytes, or one document.
SLICE_BYTES = 1 << 20
#: Up to this many rows of a few integers are broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share; a local one only where none is set and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='tessera-')}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, wherever Spark keeps it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Rows of documents in an Arrow batch; Spark's default of 10000 rows would hold tens of megabytes on both sides.
BATCH_ROWS = 1000


def light_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of the session's plans from now on (rows hold whole documents), unless set lower."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def file_bytes(df: DataFrame) -> int | None:
    """The size of the files that a plan reads, as Spark has listed them; None where it reads something else too."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(0 <= n < 1 << 55 for n in sizes) else None  # rows in memory have no size of their own


#: Rows of a few integers that one partition of a small table holds.
PARTITION_ROWS = 20_000


def drop_finished(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, as it does whenever the driver
    collects garbage; without a word that may be long after the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows of a few integers in no more partitions than they need, without a shuffle: each
    partition of a small table would write a file of its own at every exchange that follows."""
    return df.coalesce(max(1, -(-rows // PARTITION_ROWS)))


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a checkpointed table of a few integer columns if it was counted to be small."""
    return F.broadcast(df) if df.count() <= limit else df


def beside(rows: DataFrame, queries: DataFrame, most: int, key: str = "vec_id", least: int = 8192) -> DataFrame:
    """Blocks of rows, by hash, one a partition, each followed by all queries: the columns of both with ``asks``.

    Rows are shuffled once and queries once a block; a task holds one block (``most`` rows or so) and streams past it.
    Smaller blocks, down to ``least`` rows, keep all tasks busy.
    """
    n = rows.count()
    blocks = max(1, -(-n // most), min(parallelism(rows.sparkSession), -(-n // least)))
    left = rows.withColumn("asks", F.lit(False)).withColumn("block", F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int"))
    right = queries.withColumn("asks", F.lit(True)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.union(right).repartitionById(blocks, "block").sortWithinPartitions("asks").drop("block")


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and the next stage needs the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only the GNU library has it
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
SHINGLE_MUL = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 4 + 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_VALUE = BYTE_VALUE[LOWER]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[size] = tuple(both)
    return _powers[size]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and n + 1 word offsets by text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True  # a text's first byte is never joined to the text before it
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased: a polynomial by prefix sums, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * SHINGLE_MUL[63])


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text of 1 to ``width - 1`` words is one shingle (the whole sequence, which equals no full shingle);
    a text without words, or null, has none.
    """
    raw, offsets = text_bytes(column)
    starts, ends, at = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    n = max(0, len(h) - width + 1)
    full = np.zeros(n, np.uint64)
    for j in range(width):
        full += h[j : j + n] * SHINGLE_MUL[j]
    full = mix(full + SHINGLE_MUL[62])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((h[a:b] * SHINGLE_MUL[: b - a]).sum(dtype=np.uint64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): rows (id, component) with the smallest reachable id.

    Alternating large-star and small-star rounds; each is two aggregations with map-side combination and
    joins on small rows, checkpointed.  Self-loops, repeats and null ends are ignored.  Empty in, empty out.
    """
    e = checkpoint(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = e.count()
    while True:
        both = few(e.union(e.select("b", "a")), 2 * size)  # no step makes more rows than these
        low = few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), 2 * size)
        large = few(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"), 2 * size).distinct()
        large = few(large, 2 * size)
        down = few(large.groupBy("a").agg(F.min("b").alias("m")), 2 * size)
        small = few(large.join(down, "a"), 2 * size).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(down.select("a", "m")).distinct()
        new = checkpoint(few(small, 2 * size))
        before, size = size, new.count()
        changed = size != before or few(new.join(few(e, size), ["a", "b"], "left_anti"), size).limit(1).count()  # both hold distinct rows
        e = new
        if not changed:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))


def unit_codes(texts: pa.Array, more: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The units of texts between single spaces (and of texts cut already): distinct units, a code for each unit, and
    the number of units of each text."""
    split = pc.split_pattern(texts, " ")
    values, counts = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if more:
        values = pa.concat_arrays([values, pa.array([u for m in more for u in m], values.type)])
        counts = np.concatenate([counts, np.array([len(m) for m in more], np.int64)])
    coded = values.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def gathered(blobs: list[bytes], codes: np.ndarray, counts: np.ndarray, kind: str) -> tuple[np.ndarray, list[int]]:
    """The numbers behind all codes in a row, and where those of each text end."""
    flat = np.frombuffer(b"".join(blobs), kind)
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // flat.itemsize
    start = np.cumsum(size) - size
    size = size[codes]
    until = np.cumsum(size)
    total = int(until[-1]) if len(until) else 0
    index = np.repeat(start[codes] - (until - size), size)
    index += np.arange(total)
    return flat[index], np.concatenate(([0], until))[np.cumsum(counts)].tolist()


def gathered_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together, or cut between rows, so that ``column`` holds about ``limit`` bytes in each."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, column, limit):
        own = part.column(column)
        own = int(pc.sum(pc.fill_null(pc.binary_length(own), 0)).as_py() or 0)
        if kept and size + own > limit:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches(max_chunksize=None)[0]
            kept, size = [], 0
        kept.append(part)
        size += own
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches(max_chunksize=None)[0]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as a compressed binary; ``unpacked`` reads it."""
    data = np.ascontiguousarray(numbers).tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)
