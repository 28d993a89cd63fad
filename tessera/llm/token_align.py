"""Alignment of two tokenizers over the same bytes.

A block of documents (an Arrow batch of some ``BLOCK_BYTES`` of text) is laid end to end, so that every token of either
tokenizer has one place on one byte axis.  The ends of A's and of B's tokens are counted once over that axis
(``bincount``): a byte where both end cuts the groups, a byte where either ends closes a link, for between two
neighbouring ends lie one token of A and one of B.  Prefix sums over the ends tell which; sums by segment give each
document its figures.

How many documents hold a linked pair of ids is summed over the blocks' distinct pairs, with each block's own count, so
a pair that stands in every document costs one row a block; the counts come back to the blocks the same way.

Texts are encoded by the tokenizers' own libraries.  Units between single spaces are encoded once a task and looked up
from then on: neither tokenizer joins over a single space between two other characters.  Texts with other white space
go to the libraries whole.

Edge cases.  A text that is null or empty, or whose tokens do not spell a space and the text (a normaliser changed it, a
piece is unknown), has no tokens: zeros and an empty ``groups_sha256``.  Each row counts as a document of its own, also
where rows share a doc_id, and stays a row.  Ties for an id's best count are all best.  An empty table gives no rows;
other columns are ignored, whatever their names.  A text is never split, so a task holds some 150 times the bytes of its
longest text or block.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, gathered, gathered_blocks, give_back, light_batches, packed, remove, shared_dir, unit_codes, unpacked
from .token_store import EXOTIC, MARK, Encoder

BLOCK_BYTES = 4 << 20
CACHE_UNITS = 600_000
SPACE = "▁"
_ODD = re.compile("|".join(map(re.escape, (*EXOTIC, MARK))))
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow
    from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """The bytes of a vocabulary's tokens: all in a row, and where each begins."""

    def __init__(self, names: list[bytes]):
        self.size = np.fromiter(map(len, names), np.int64, len(names))
        self.names = names

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join([self.names[i] for i in ids.tolist()])


class Pair:
    """Both tokenizers and the units they know: the ids of A and of B for a space and a unit, empty where those differ."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, vocabulary = byte_alphabet(), self.a.tokenizer.get_vocab()
        names = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():  # a special token's string is not made of the alphabet's characters alone
            names[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.of_a = Tokens(names)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_b = Tokens([bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces])
        self.units: dict[str, tuple[bytes, bytes]] = {}

    def _checked(self, text: str, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes] | None:
        spelt = (" " + text).encode()
        return (a.astype("<u4").tobytes(), b.astype("<u4").tobytes()) if self.of_a.spell(a) == spelt == self.of_b.spell(b) else None

    def _learn(self, new: list[str]) -> None:
        self.a._learn(new)
        for unit, b in zip(new, self.b.encode(new, num_threads=1), strict=True):
            self.units[unit] = self._checked(unit, np.frombuffer(self.a.units[unit], "<u4"), np.array(b, "<u4")) or (b"", b"")
        self.a.units = {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of A and of B of all texts in a row, and n + 1 offsets of each; texts without an alignment have none."""
        n = len(texts)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        plain, odd = [], []
        for i, t in enumerate(texts):
            if t:
                (odd if t[0].isspace() or t[-1].isspace() or _ODD.search(t) else plain).append(i)
        if odd:
            whole = [texts[i] for i in odd]
            got = self.a.tokenizer.encode_batch_fast([" " + t for t in whole], add_special_tokens=False)
            for i, t, x, y in zip(odd, whole, got, self.b.encode(whole, num_threads=1), strict=True):
                x, y = np.array(x.ids, np.uint32), np.array(y, np.uint32)
                if self._checked(t, x, y):
                    found[i] = x, y
        if plain:
            units, codes, counts = unit_codes(pa.array([texts[i] for i in plain], pa.large_string()), [])
            new = [u for u in units if u not in self.units]
            self._learn(new)
            blobs = [self.units[u] for u in units]
            bad = np.fromiter((not x for x, _ in blobs), bool, len(blobs))
            ends = np.cumsum(counts)
            spoilt = np.diff(np.concatenate(([0], np.cumsum(bad[codes])[ends - 1]))) > 0
            (flat_a, to_a), (flat_b, to_b) = gathered([x for x, _ in blobs], codes, counts, "<u4"), gathered([y for _, y in blobs], codes, counts, "<u4")
            if not spoilt.any() and len(plain) == n:
                out = flat_a, np.array([0, *to_a]), flat_b, np.array([0, *to_b])
                self._trim(units)
                return out
            for i, no, x, y, z, w in zip(plain, spoilt.tolist(), [0, *to_a[:-1]], to_a, [0, *to_b[:-1]], to_b, strict=True):
                if not no:
                    found[i] = flat_a[x:y], flat_b[z:w]
            self._trim(units)
        none = np.zeros(0, np.uint32)
        both = [found.get(i, (none, none)) for i in range(n)]
        size_a, size_b = np.array([len(x) for x, _ in both]), np.array([len(y) for _, y in both])
        return np.concatenate([none, *[x for x, _ in both]]), np.concatenate(([0], np.cumsum(size_a))), np.concatenate([none, *[y for _, y in both]]), np.concatenate(([0], np.cumsum(size_b)))

    def _trim(self, units: list[str]) -> None:
        if len(self.units) > CACHE_UNITS:
            self.units = {u: self.units[u] for u in units}


@cache
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Aligned:
    """Documents' tokens on one byte axis: groups and links of a whole block."""

    def __init__(self, a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        """``at_a`` and ``at_b``: n + 1 offsets of the documents; ``size_a`` and ``size_b``: the bytes of each id."""
        self.a, self.b, self.at_a, self.at_b = a, b, at_a, at_b
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        total = int(end_a[-1]) if len(end_a) else 0
        ends = np.bincount(end_a, minlength=total + 1).astype(np.uint8)
        ends += np.bincount(end_b, minlength=total + 1).astype(np.uint8) << 1
        places = np.flatnonzero(ends)  # every end of a token: one link closes at each
        kind = ends[places].astype(np.int64)
        del ends
        both = kind == 3
        # A link's tokens are those after the ends before it.
        self.link_a = np.cumsum(kind & 1) - (kind & 1)
        self.link_b = np.cumsum(kind >> 1) - (kind >> 1)
        self.cut_a, self.cut_b = (self.link_a[both] + 1), (self.link_b[both] + 1)  # the tokens up to each group's end
        # By document: links and groups up to its last byte.
        self.at_link = np.searchsorted(self.link_a, at_a)
        self.at_group = np.searchsorted(self.cut_a, at_a, side="right")

    def spelt(self, digits: Digits) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of all documents in a row, and n + 1 byte offsets."""
        n_a, n_b = len(self.a), len(self.b)
        size_a, size_b = np.diff(self.cut_a, prepend=0), np.diff(self.cut_b, prepend=0)
        place_a = np.arange(n_a) + np.repeat(self.cut_b - size_b, size_a)  # behind the tokens of B in earlier groups
        place_b = np.arange(n_b) + np.repeat(self.cut_a, size_b)  # behind the tokens of A up to its own group's
        ids, after = np.zeros(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a[self.cut_a - 1]], after[place_b[self.cut_b - 1]] = ord("|"), ord(";")
        cells = digits.cells[ids]
        cells[:, -1] = after
        use = digits.used[ids]
        until = np.concatenate(([0], np.cumsum(digits.length[ids])))
        return cells[use].tobytes(), until[self.at_a + self.at_b]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every link."""
        return self.a[self.link_a].astype(np.int64), self.b[self.link_b].astype(np.int64)


class Digits:
    """The decimal digits of the numbers below ``n``, each in a row of one width with room for a mark behind them."""

    def __init__(self, n: int):
        width = len(str(max(n - 1, 0)))
        self.cells = np.zeros((n, width + 1), np.uint8)
        self.used = np.zeros((n, width + 1), bool)
        numbers = np.arange(n)
        length = np.ones(n, np.int64)
        for k in range(1, width):
            length += numbers >= 10**k
        for k in range(width):
            self.cells[:, k] = 48 + numbers // 10 ** (width - 1 - k) % 10
            self.used[:, k] = width - k <= length
        self.used[:, width] = True
        self.length = length + 1


@cache
def digits_below(n: int) -> Digits:
    return Digits(n)


_BLOCKS = "block string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, n_pairs array<int>, codes binary, times binary, a array<int>, b array<int>, docs array<int>"


def _aligned(path_a: str, path_b: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = pair_of(path_a, path_b)
        span = len(use.of_b.names)
        digits = digits_below(max(len(use.of_a.names), span))
        for part in gathered_blocks(batches, "text", block_bytes):
            a, at_a, b, at_b = use.encode(part.column("text").to_pylist())
            got = Aligned(a, at_a, b, at_b, use.of_a.size, use.of_b.size)
            text, at = got.spelt(digits)
            sha = [hashlib.sha256(memoryview(text)[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            del text
            id_a, id_b = got.pairs()
            known, code = np.unique(id_a * span + id_b, return_inverse=True)
            links = np.diff(got.at_link)
            held, times = np.unique(np.repeat(np.arange(len(links)), links) * max(1, len(known)) + code, return_counts=True)
            doc, held = np.divmod(held, max(1, len(known)))
            n_pairs = np.bincount(doc, minlength=len(links))
            step = np.diff(held, prepend=0)
            first = np.concatenate(([0], np.cumsum(n_pairs)[:-1]))[n_pairs > 0]
            step[first] = held[first]
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t))
            columns = [pa.array([uuid.uuid4().hex]), one(part.column("doc_id"), pa.int64())]
            columns += [one(np.diff(x), pa.int64()) for x in (got.at_a, got.at_b, got.at_group, got.at_link)]
            columns += [one(sha, pa.string()), one(n_pairs, pa.int32()), pa.array([packed(step.astype("<u4"))], pa.binary()), pa.array([packed(times.astype("<u4"))], pa.binary())]
            columns += [one(x, pa.int32()) for x in (known // span, known % span, np.bincount(held, minlength=len(known)))]
            yield pa.record_batch(columns, names=[x.split()[0] for x in _BLOCKS.split(", ")])
        give_back()

    return run


_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's sums over its own pairs, from the counts of its block's pairs."""
    for batch in batches:
        for k in range(batch.num_rows):
            list_of = lambda c: batch.column(c)[k].values
            n_pairs = list_of("n_pairs").to_numpy()
            codes, times = unpacked(batch.column("codes")[k].as_py(), "<u4"), unpacked(batch.column("times")[k].as_py(), "<u4").astype(np.int64)
            ends = np.cumsum(n_pairs)
            run = np.cumsum(codes.astype(np.int64))
            some = n_pairs > 0
            first = (ends - n_pairs)[some]
            code = run - np.repeat(run[first] - codes[first], n_pairs[some])
            found = batch.column("found")[k].values
            count, best = np.zeros(len(found) if found is not None else 0, np.int64), np.zeros(len(found) if found is not None else 0, bool)
            if len(count):
                at = found.field("at").to_numpy()
                count[at], best[at] = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))]) for x in (times * best[code], times * count[code])]
            columns = [list_of(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(x, pa.int64()) for x in sums] + [list_of("sha")]
            yield pa.record_batch(columns, names=[x.split()[0] for x in _ROWS.split(", ")])
    give_back()


def blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of aligned documents: figures by document, the links' distinct id pairs, and who holds which how often."""
    rows = light_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_aligned(path_a, path_b, block_bytes), _BLOCKS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """How many documents hold each pair (a, b), and whether none of its A id's pairs is held by more: a, b, n, best.

    A window holds the pairs of one A id, at most one for each id of B.
    """
    counts = pairs.groupBy("a", "b").agg(F.sum(F.col("docs").cast("long")).alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    blocks(docs, path_a, path_b, block_bytes).write.parquet(folder)
    stored = spark.read.parquet(folder)
    pairs = stored.select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("at", "pair")).select("block", "at", "pair.*")
    found = pairs.join(pair_counts(pairs), ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))
    rows = stored.drop("a", "b", "docs").join(found, "block", "left").mapInArrow(_summed, _ROWS)
    rows = checkpoint(rows)
    remove(spark, folder)
    return rows
