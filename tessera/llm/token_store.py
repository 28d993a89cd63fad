"""Token ids in directly addressable codes.

A segment file holds the ids of consecutive documents.  Each id is split into 8-bit chunks: level 0 has the lowest
chunk of every id, level k the next chunk of those ids that need it.  A bitmap on each level tells which of its
entries continue, and a rank directory (set bits before each 512-bit block) finds an entry's place on the next level.
So any token is read by a few lookups, without decoding its neighbours.

Layout, little-endian: magic ``TDAC``, u32 version, i64 part, i64 first (tokens of earlier segments of the part), u64
tokens, u64 documents, u32 levels; i64 doc_ids (with a u8 null flag each), u64 offsets (documents + 1); then for each
level u64 entries, the chunk bytes, u64 bitmap words, u32 block ranks.

Segments are stand-alone, uncompressed files, one row of Spark's text writer each (its line end follows the last byte),
so any shared store works and a lost executor only repeats its tasks.  ``SegmentFile`` reads a token of a stored file
by seeking: a byte, a bitmap block and a rank a level.  Parts are ranges of doc_id of some ``PART_BYTES`` of input files (or of
text, where the input is no file); a document's start is its part's start, from the parts' totals, and its place in the part, which the file tells.

Edge cases.  Null text counts as empty: only the end id.  A null doc_id sorts first; rows that share a doc_id follow
each other by text.  A document is never split, whatever its length.  Empty tables write no segment.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, file_bytes, gathered, give_back, light_batches, parallelism, shared_dir, sized_broadcast, slices, unit_codes

MAGIC, VERSION = b"TDAC", 2
HEAD = struct.Struct("<4sIqqQQI")
BLOCK_WORDS = 8  # bitmap words a rank entry covers
SEGMENT_TOKENS = 1 << 20
PART_BYTES = 32 << 20
END_ID = 2
CACHE_UNITS = 1_200_000
MARK = "\x00"  # stands before a text's first unit
#: White space beside single spaces between other characters; texts with it are cut with more care.
EXOTIC = ("  ", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class Encoder:
    """Encodes texts with a tokenizer file of the tokenizers library, remembering units between single spaces.

    A byte-level pre-tokenizer always cuts before a single space that stands between two non-space characters, so the
    units there are encoded on their own; every new unit goes through the library, many in one text.
    """

    _cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units: dict[str, bytes] = {}
        opens = [t.startswith("\u0120") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.opens = np.array(opens + [False])  # pieces that begin with a space, which only a unit's first piece does

    def _learn(self, new: list[str]) -> None:
        """Units with a mark in front begin a text; those with spaces inside go alone; all others many to a text."""
        plain = [u for u in new if u[0] != MARK and " " not in u]
        alone = [u for u in new if u[0] == MARK or " " in u]
        texts = [u[1:] if u[0] == MARK else " " + u for u in alone]
        for unit, got in zip(alone, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.units[unit] = np.array(got.ids, "<u4").tobytes()
        groups = [plain[a : a + 512] for a in range(0, len(plain), 512)]
        for part, got in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) != len(part):  # a special piece swallowed a space: one by one
                for unit, one in zip(part, self.tokenizer.encode_batch_fast([" " + u for u in part], add_special_tokens=False), strict=True):
                    self.units[unit] = np.array(one.ids, "<u4").tobytes()
                continue
            cut = [*(4 * cut).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            for unit, x, y in zip(part, cut[:-1], cut[1:], strict=True):
                self.units[unit] = data[x:y]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (u32)."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        at = [i for i, t in enumerate(texts) if t]
        odd: list[int] = []
        whole = "".join([f" {MARK}{texts[i]}" for i in at])
        if any(x in whole for x in EXOTIC) or whole.count(MARK) != len(at) or f"{MARK} " in whole or whole[-1:].isspace():
            marked = [i for i in at if MARK in texts[i]]
            for i, got in zip(marked, self.tokenizer.encode_batch_fast([texts[i] for i in marked], add_special_tokens=False), strict=True):
                out[i] = np.array(got.ids, np.uint32)
            odd = [i for i in at if MARK not in texts[i] and (texts[i][0] == " " or texts[i][-1].isspace() or any(x in texts[i] for x in EXOTIC))]
            at = sorted(set(at) - set(marked) - set(odd))
        del whole
        if not at and not odd:
            return out
        units, codes, counts = unit_codes(pa.array([MARK + texts[i] for i in at], pa.large_string()), [[MARK + u if k == 0 else u for k, u in enumerate(self._cut.split(texts[i]))] for i in odd])
        known = self.units
        blobs = list(map(known.get, units))
        if None in blobs:
            self._learn([u for u, b in zip(units, blobs, strict=True) if b is None])
            blobs = [known[u] if b is None else b for u, b in zip(units, blobs, strict=True)]
        flat, ends = gathered(blobs, codes, counts, "<u4")
        if len(known) > CACHE_UNITS:
            self.units = {u: known[u] for u in units}
        for i, a, b in zip([*at, *odd], [0, *ends[:-1]], ends, strict=True):
            out[i] = flat[a:b]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(doc_ids: list[int | None], ids: list[np.ndarray], tails: list[np.ndarray] | None = None, part: int = 0, first: int = 0) -> bytes:
    """The segment file of these documents, each with its tail behind; ``first`` tokens of the part stand before it."""
    if tails is not None:
        ids = [x for pair in zip(ids, tails, strict=True) for x in pair]
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint32)
    ends = np.cumsum([len(x) for x in ids])
    offsets = np.concatenate(([0], ends if tails is None else ends[1::2])).astype("<u8")
    levels, rest = [], flat
    while True:
        more = rest >> np.uint32(8)
        bits = more != 0
        words = np.packbits(bits, bitorder="little")
        words = np.concatenate([words, np.zeros(-len(words) % (8 * BLOCK_WORDS), np.uint8)])
        counts = np.bitwise_count(words.view("<u8")).reshape(-1, BLOCK_WORDS).sum(axis=1) if len(words) else np.zeros(0)
        ranks = (np.cumsum(counts) - counts).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + words.tobytes() + ranks.tobytes())
        if not bits.any():
            break
        rest = more[bits]
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([HEAD.pack(MAGIC, VERSION, part, first, len(flat), len(doc_ids), len(levels)), known.tobytes(), null.tobytes(), offsets.tobytes(), *levels])


class Segment:
    """Reads a segment file; ``token`` and ``take`` address single tokens, ``document`` a document's range."""

    def __init__(self, data: bytes):
        magic, version, self.part, self.first, self.n_tokens, self.n_docs, levels = HEAD.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token segment")
        at = HEAD.size

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        known, null = read("<i8", self.n_docs), read("u1", self.n_docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(known, null, strict=True)]
        self.offsets = read("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            blocks = -(-n // (64 * BLOCK_WORDS))
            self.levels.append((read("u1", n), read("<u8", blocks * BLOCK_WORDS), read("<u4", blocks)))

    def take(self, index: np.ndarray) -> np.ndarray:
        """The ids at these positions, each found by bitmap and rank lookups alone."""
        place = np.asarray(index, np.int64)
        out, live = np.zeros(len(place), np.uint32), np.arange(len(place))
        for k, (chunks, words, ranks) in enumerate(self.levels):
            out[live] |= chunks[place].astype(np.uint32) << np.uint32(8 * k)
            word = place >> 6
            more = (words[word] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            live, place, word = live[more], place[more], word[more]
            if not len(live):
                break
            block = word // BLOCK_WORDS
            rank = ranks[block].astype(np.int64)
            for j in range(BLOCK_WORDS - 1):  # whole words of the block before the entry's own
                at = block * BLOCK_WORDS + j
                rank += np.where(at < word, np.bitwise_count(words[at]), 0)
            below = words[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            place = rank + np.bitwise_count(below)
        return out

    def token(self, i: int) -> int:
        return int(self.take(np.array([i]))[0])

    def document(self, k: int) -> np.ndarray:
        return self.take(np.arange(self.offsets[k], self.offsets[k + 1]))

    def all(self) -> np.ndarray:
        """Every id, level by level, without ranks."""
        out, live = np.zeros(self.n_tokens, np.uint32), np.arange(self.n_tokens)
        for k, (chunks, words, _) in enumerate(self.levels):
            out[live] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            live = live[np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[: len(live)])]
        return out


class SegmentFile:
    """Single tokens of a stored segment, by ``read(offset, size)`` of a few bytes each."""

    def __init__(self, file: BinaryIO):
        self.file = file
        magic, version, self.part, self.first, self.n_tokens, self.n_docs, levels = HEAD.unpack(self.read(0, HEAD.size))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token segment")
        self.offsets = HEAD.size + 9 * self.n_docs
        at = self.offsets + 8 * (self.n_docs + 1)
        self.levels = []  # where each level's chunks, bitmap and ranks begin
        for _ in range(levels):
            (n,) = struct.unpack("<Q", self.read(at, 8))
            blocks = -(-n // (64 * BLOCK_WORDS))
            chunks = at + 8
            words = chunks + n
            ranks = words + 8 * BLOCK_WORDS * blocks
            self.levels.append((chunks, words, ranks))
            at = ranks + 4 * blocks

    def read(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def document(self, k: int) -> tuple[int, int]:
        """Where the k-th document's tokens begin and end."""
        return struct.unpack("<QQ", self.read(self.offsets + 8 * k, 16))

    def token(self, i: int) -> int:
        out = 0
        for k, (chunks, words, ranks) in enumerate(self.levels):
            out |= self.read(chunks + i, 1)[0] << (8 * k)
            block, bit = divmod(i, 64 * BLOCK_WORDS)
            bits = int.from_bytes(self.read(words + 8 * BLOCK_WORDS * block, 8 * BLOCK_WORDS), "little")
            if not bits >> bit & 1:
                return out
            i = struct.unpack("<I", self.read(ranks + 4 * block, 4))[0] + (bits & ((1 << bit) - 1)).bit_count()
        return out


def _writer(path: str, end_id: int):
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, size = TaskContext.get().partitionId(), 0, 0
        docs, ids = [], []
        use = encoder(path)

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([pack(docs, ids[::2], ids[1::2], part, first)], pa.binary())], names=["file"])

        for piece in slices(batches, limit=8 << 20):
            for doc, got in zip(piece.column("doc_id").to_pylist(), use.encode(piece.column("text").to_pylist()), strict=True):
                docs.append(doc)
                ids += (got, tail)
                size += len(got) + 1
                if size >= SEGMENT_TOKENS:
                    yield flush()
                    docs, ids, first, size = [], [], first + size, 0
        if docs:
            yield flush()
        docs, ids = [], []
        give_back()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> str:
    """Write ``docs(doc_id, text)`` as token segments in ascending doc_id order under ``out``."""
    rows = light_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = file_bytes(rows)
    if size is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(max(parallelism(docs.sparkSession), -(-size // part_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(_writer(tokenizer_path, end_id), "file binary")
    made.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(out)
    return out


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of segment files.  Each document's first and last token are also read by their address."""
    for batch in batches:
        for file in batch.column("content"):
            segment = Segment(file.as_buffer())
            ids = segment.all().astype("<u4")
            offsets = segment.offsets
            ends = np.concatenate([offsets[:-1], offsets[1:] - 1])[np.tile(np.diff(offsets) > 0, 2)]
            if (segment.take(ends) != ids[ends]).any():
                raise ValueError("a token read by its address differs from the decoded one")
            cut = offsets.tolist()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([pa.array(np.full(segment.n_docs, segment.part)), pa.array(segment.doc_ids, pa.int64()), pa.array(offsets[:-1] + segment.first), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])
    give_back()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    docs = checkpoint(files.where("length > 0").select("content").mapInArrow(_documents, "part long, doc_id long, start long, n_tokens long, ids_crc32 long"))
    totals = docs.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part of PART_BYTES or so
    parts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return docs.join(sized_broadcast(checkpoint(parts)), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_documents(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` and read them back; ``out`` is a new folder in the shared one unless given."""
    spark = docs.sparkSession
    return read_documents(spark, write_tokens(docs, tokenizer_path, out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", end_id))
