"""Phrase collocations of each language, from exact counts of all phrases of two to five words.

1. Blocks of some ``BLOCK_BYTES`` of one language's text are cut into pieces and words; a block keeps its distinct words
   with their counts, and its words as numbers of its own (``piece_blocks``).
2. Words with at least ``least`` occurrences in their language get ids, by a join of the blocks' distinct words with the
   counts; a word costs one row a block however often it stands there.  Pieces break at all other words.
3. Every place that has a neighbour gives one window: the ids of up to five words from there on, in a binary key of five
   32-bit numbers, zero behind the piece's end.  A phrase's occurrences are the windows that begin with it.  A block sorts its windows
   (radix sort, 16 bits a pass) and counts equal ones, so a repeated passage costs as much as one a block.
4. Windows are shuffled by ranges of keys, taken from evenly spaced windows of all blocks.  A range is sorted again and
   the runs of equal beginnings are counted for each length.  A run that touches an end of its range may go on in the
   next, so it is kept whatever its count, and sums over all ranges are exact.
5. Scores, and which phrases stand inside others, are joins of the frequent phrases with themselves.  Products are
   decimals of 38 digits: exact as long as a language has no more than 10^17 words.

The sample of windows (``SAMPLE`` a block, of as many blocks as give some ``MOST_SAMPLES``) steers only where the ranges are cut.

Edge cases.  Null text counts as empty, null language as ``und``; rows without words count nothing.  Ties go to the phrase that is
first by its UTF-8 bytes; of equal cuts, to the shortest first part.  Repeated rows count each time.  An empty table, or
one without phrases that are frequent enough, gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, checkpoint, gathered_blocks, give_back, light_batches, packed, parallelism, remove, shared_dir, text_bytes, unpacked

UND = "und"
LONGEST = 5
LEAST = 100
TOP = 2000
BLOCK_BYTES = 6 << 20
RANGE_WINDOWS = 1 << 20
SAMPLE = 256
MOST_SAMPLES = 1 << 20
KEY_BYTES = 4 * LONGEST

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True


def cut_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z lower-cased, and where a new piece begins."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    broken = _BREAK[raw]
    solid = ~(_WHITE[raw] | broken)
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True  # a text's first byte begins a word, or none does
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    data = raw[solid]
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
    broken = np.cumsum(broken | first[:-1], dtype=np.int32)  # a text's end breaks as a mark does
    piece = broken[starts]
    return words, np.concatenate(([True], piece[1:] != piece[:-1]))[: len(starts)]


def _blocks(limit: int):
    """Blocks by language: distinct words, their counts, and the words as 1-based codes with 0 before each piece."""

    def block(lang: str, texts: pa.Array) -> pa.RecordBatch:
        words, opens = cut_words(texts)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
        counts = np.bincount(codes, minlength=len(coded.dictionary))
        codes = np.insert(codes + np.uint32(1), np.flatnonzero(opens), np.uint32(0))
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t))
        return pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([lang]), one(coded.dictionary, pa.string()), one(counts, pa.int64()), pa.array([packed(codes)], pa.binary())], names=["block", "lang", "words", "counts", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered_blocks(batches, "text", limit):
            langs = part.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = part.column("text").filter(pa.array(code == k))
                if pc.any(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)).as_py():
                    yield block(lang, texts)
        give_back()

    return run


def piece_blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``docs(text, lang)``."""
    rows = light_batches(docs).select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"))
    return rows.mapInArrow(_blocks(limit), "block string, lang string, words array<string>, counts array<long>, codes binary")


def numbered_words(counts: DataFrame, folder: str) -> DataFrame:
    """Ids from 1 on for the words of ``counts(lang, word, f)``; written, so that they stay."""
    spark = counts.sparkSession
    counts.withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.schema("lang string, word string, f long, row long").parquet(folder)
    part = F.shiftright("row", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    return rows.join(F.broadcast(before), part == F.col("part")).select("lang", "word", "f", (F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("id"))


def windows(ids: np.ndarray) -> np.ndarray:
    """Per place whose neighbour is no break (0), the next ``LONGEST`` ids, zeros from the first break on."""
    padded = np.concatenate([ids, np.zeros(LONGEST, np.uint32)])
    start = np.flatnonzero((padded[:-1] != 0)[: len(ids)] & (padded[1:] != 0)[: len(ids)])
    out = np.zeros((LONGEST, len(start)), np.uint32)
    live = np.ones(len(start), bool)
    for k in range(LONGEST):
        out[k] = padded[start + k]
        live &= out[k] != 0
        out[k] *= live
    return out


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of the columns of ``keys``, first row first: from the last 16 bits to the first, each pass stable."""
    order = np.arange(keys.shape[1])
    for row in keys[::-1]:
        for shift in (0, 16):
            digit = (row >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct columns and the sums of ``times`` (1 each without)."""
    order = radix_order(keys)
    keys = keys[:, order]
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    sums = np.diff(np.append(first, keys.shape[1])) if times is None else (np.add.reduceat(times[order], first) if len(first) else times)
    return keys[:, first], sums.astype(np.int64)


def names_of(keys: np.ndarray) -> np.ndarray:
    """Keys as big-endian bytes, which compare as the keys do."""
    return np.ascontiguousarray(keys.T.astype(">u4")).view(f"S{4 * len(keys)}").reshape(-1)


_IDS = "n long, sample binary, ids binary"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in global ids, 0 for breaks and words that are not frequent, with evenly spaced windows as a sample."""
    for batch in batches:
        for k in range(batch.num_rows):
            codes = unpacked(batch.column("codes")[k].as_py(), "<u4")
            found = batch.column("found")[k].values
            ids = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
            ids[found.field("at").to_numpy() + 1] = found.field("id").to_numpy()
            ids = ids[codes]
            keys = windows(ids)
            n = keys.shape[1]
            if n:
                some = names_of(keys[:, np.unique(np.linspace(0, n - 1, SAMPLE).astype(np.int64))])
                yield pa.record_batch([pa.array([n]), pa.array([some.tobytes()], pa.binary()), pa.array([packed(ids)], pa.binary())], names=["n", "sample", "ids"])
    give_back()


def _dealt(bounds: bytes):
    """Each block's windows sorted, counted and cut at the bounds: one row for each range that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.frombuffer(bounds, f"S{KEY_BYTES}")
        for batch in batches:
            for k in range(batch.num_rows):
                keys, times = counted(windows(unpacked(batch.column("ids")[k].as_py(), "<u4")))
                edges = [0, *np.searchsorted(names_of(keys), cuts).tolist(), keys.shape[1]]
                rows = [(r, packed(keys[:, a:b]), packed(times[a:b].astype("<u4"))) for r, (a, b) in enumerate(pairwise(edges)) if b > a]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["range", "keys", "times"])
        give_back()

    return run


def _runs(least: int):
    """Counts of the phrases of each range: runs of equal beginnings, length by length."""

    def phrases(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        keys, times = counted(keys, times)
        n = keys.shape[1]
        sums = np.concatenate(([0], np.cumsum(times)))
        new = np.zeros(n, bool)
        new[0] = True
        out_keys, out_f = [], []
        for length in range(1, LONGEST + 1):
            new[1:] |= keys[length - 1, 1:] != keys[length - 1, :-1]
            if length == 1:
                continue
            first = np.flatnonzero(new)
            last = np.append(first[1:], n)
            f = sums[last] - sums[first]
            use = (f >= least) | (first == 0) | (last == n)  # the outer runs may go on in other ranges
            use &= keys[length - 1, first] != 0
            some = np.ascontiguousarray(keys[:length, first[use]].T.astype(">u4"))
            out_keys += [x.tobytes() for x in some]
            out_f.append(f[use])
        return pa.record_batch([pa.array(out_keys, pa.binary()), pa.array(np.concatenate(out_f), pa.int64())], names=["phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, times = None, [], []
        for batch in batches:
            for r, x, y in zip(batch.column("range").to_pylist(), batch.column("keys"), batch.column("times"), strict=True):
                if r != here and keys:
                    yield phrases(np.concatenate(keys, axis=1), np.concatenate(times))
                    keys, times = [], []
                here = r
                keys.append(unpacked(x.as_py(), "<u4").reshape(LONGEST, -1))
                times.append(unpacked(y.as_py(), "<u4").astype(np.int64))
        if keys:
            yield phrases(np.concatenate(keys, axis=1), np.concatenate(times))
        keys, times = [], []
        give_back()

    return run


def range_bounds(samples: list[bytes], total: int, range_windows: int) -> bytes:
    """Keys that cut the sampled windows evenly: one for each ``range_windows`` windows, in order, each once."""
    keys = np.frombuffer(b"".join(samples), ">u4").reshape(-1, LONGEST).T.astype(np.uint32)
    keys = keys[:, radix_order(keys)]
    ranges = max(1, min(-(-total // range_windows), keys.shape[1]))
    picked, _ = counted(keys[:, np.arange(1, ranges) * keys.shape[1] // ranges])
    return names_of(picked).tobytes()


def counted_phrases(encoded: DataFrame, least: int, range_windows: int) -> DataFrame:
    """Phrases of at least two words (their ids, big-endian, in one binary) with at least ``least`` occurrences: phrase, f."""
    spark = encoded.sparkSession
    total, blocks = encoded.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "phrase binary, f long")
    asked = F.pmod(F.xxhash64("sample"), F.lit(1 << 20)) < MOST_SAMPLES * (1 << 20) // (SAMPLE * blocks)
    bounds = range_bounds([r["sample"] for r in encoded.where(asked).select("sample").collect()], total, range_windows)
    ranges = len(bounds) // KEY_BYTES + 1
    tasks = min(ranges, 4 * parallelism(spark))
    dealt = encoded.select("ids").mapInArrow(_dealt(bounds), "range int, keys binary, times binary")
    dealt = dealt.withColumn("task", F.expr(f"cast(range * {tasks}L div {ranges}L as int)")).repartitionById(tasks, "task").sortWithinPartitions("range")
    return dealt.select("range", "keys", "times").mapInArrow(_runs(least), "phrase binary, f long").groupBy("phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _part(start: Column, words: Column) -> Column:
    """Some words of ``phrase``, as a phrase."""
    return F.substring("phrase", (start * 4 + 1).cast("int"), (words * 4).cast("int"))


def _n_words() -> Column:
    return (F.octet_length("phrase") / 4).cast("int")


def scored_phrases(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """The lowest cut of each of ``phrases(phrase, f)``: lang, phrase, a, l, r, n, score."""
    single = words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("part"), "f", "lang")
    parts = phrases.select(F.col("phrase").alias("part"), "f", F.lit(None).cast("string").alias("lang")).union(single)
    cuts = phrases.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), _n_words() - 1)).alias("k")).select("*", _part(F.lit(0), F.col("k")).alias("left"), _part(F.col("k"), _n_words() - F.col("k")).alias("right"))
    left = parts.select(F.col("part").alias("left"), F.col("f").alias("l"), "lang")
    right = parts.select(F.col("part").alias("right"), F.col("f").alias("r"))
    found = cuts.join(left, "left").join(right, "right")
    # The first word's row alone knows the language.
    found = found.groupBy("phrase", "a").agg(F.max("lang").alias("lang"), F.collect_list(F.struct("k", "l", "r")).alias("cuts")).join(totals, "lang")
    score = F.expr("transform(cuts, c -> struct((1000BD * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(c.l as decimal(19, 0)) * cast(c.r as decimal(19, 0))) as score, c.k as k, c.l as l, c.r as r))")
    return found.withColumn("best", F.array_min(score)).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def not_inside(phrases: DataFrame, share: int) -> DataFrame:
    """The phrases that no longer one holds in at least ``share`` of a hundred of their occurrences."""
    starts = F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(0, n - m), i -> struct(i as i, m as m))))")
    inner = phrases.withColumn("n", _n_words()).where("n > 2").select("phrase", "f", F.explode(starts).alias("at")).select(_part(F.col("at.i"), F.col("at.m")).alias("inner"), "f")
    longer = inner.groupBy("inner").agg(F.max("f").alias("longer"))
    return phrases.join(longer, F.col("phrase") == F.col("inner"), "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * share)).select("phrase", "f")


def spelt(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrase`` in words, one space between two."""
    ids = F.transform(F.sequence(F.lit(0), _n_words() - 1), lambda i: F.conv(F.hex(_part(i, F.lit(1))), 16, 10).cast("long"))
    rows = phrases.select("phrase", F.posexplode(ids).alias("i", "id")).join(words.select("id", "word"), "id")
    texts = rows.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("found")).select("phrase", F.array_join("found.word", " ").alias("text"))
    return phrases.join(texts, "phrase").drop("phrase").withColumnRenamed("text", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 100, block_bytes: int = BLOCK_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """The best phrases of each language of ``docs(text, lang)``: lang, rank, phrase, a, l, r, n, score.

    ``share``: phrases go whose words stand in a longer frequent phrase in at least so many of a hundred occurrences.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    blocks = stored(piece_blocks(docs, block_bytes), "blocks")
    entry = F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("count"))
    held = blocks.select("block", "lang", F.posexplode(entry).alias("at", "own")).select("block", "lang", "at", "own.word", "own.count")
    totals = checkpoint(blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    words = checkpoint(numbered_words(held.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least), f"{folder}/words"))

    known = F.when(F.col("id").isNotNull(), F.struct("at", F.col("id").cast("int").alias("id")))  # none for words that are rare
    found = held.join(words.select("lang", "word", "id"), ["lang", "word"], "left").groupBy("block").agg(F.collect_list(known).alias("found"))
    encoded = stored(blocks.select("block", "codes").join(found, "block").select("codes", "found").mapInArrow(_encoded, _IDS), "ids")
    remove(spark, f"{folder}/blocks")
    phrases = checkpoint(counted_phrases(encoded, least, range_windows))
    remove(spark, folder)

    scored = scored_phrases(phrases, words, totals).join(not_inside(phrases, share).select("phrase"), "phrase")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = scored.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= top).drop("rank")  # with all ties
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return spelt(near, words).withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents WHERE text IS NOT NULL
),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(g, ' ') AS phrase FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS g
    FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)
),
held AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM held WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM held WHERE m > 1 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN held x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN held y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:c.m], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
places AS (SELECT lang, m, a, ws, unnest(range(1, m)) AS i FROM candidates WHERE m > 2),
inner_words AS (SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS phrase FROM places, (SELECT unnest([2, 3, 4]) AS s) WHERE s < m AND i + s - 1 <= m),
longer AS (SELECT lang, phrase, max(a) AS f FROM inner_words GROUP BY ALL),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM lowest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase
  WHERE g.f IS NULL OR 100 * g.f < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
