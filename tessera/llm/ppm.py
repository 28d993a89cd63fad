"""Language-model scores by prediction by partial matching over bytes, with a word unigram score beside it.

The model is a byte-context trie of order 5 with escape method C and symbol exclusion.  A text is its UTF-8 bytes and
one end symbol, after five start symbols.  Counts of all 6-grams of the training texts are summed by Spark; the nodes
of shorter contexts are their marginal sums.  A context's exclusions are fixed by its longer context (what was seen
after ``abcde`` was seen after ``bcde``), so three sums a context (total, distinct symbols, and what these symbols count
one order below) give every escape and every denominator.

The trie stays a table, partitioned by key.  The most frequent 6-grams, at most ``FREQUENT_GRAMS``, are broadcast with
their exact values and meet most bytes of a text by one hash lookup; every other 6-gram that occurs in a text, learned
or not, meets the nodes and sums of all orders in joins.  So nothing learned is left out at any size, and the split
changes no score.  ``adaptive_log10`` scores a single text while it learns from it.

The unigram score counts every word of the training texts.  Words above a count threshold (at most ``FREQUENT``
of them) are broadcast; the others meet their counts in a shuffled join.

Edge cases.  Null text counts as empty (its end symbol and end token are scored).  A null doc_id is not learned from.
Without training text every byte costs log10(256).  Rows that share a doc_id are scored one by one.  Whole texts are
read.  Other columns are ignored, whatever their names.  Words are told apart by 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, give_back, light_batches, sized_broadcast, slices, text_bytes, word_hashes, words
from .language_id import held_out

ORDER = 5
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
FREQUENT_GRAMS = 1 << 20
NODE_ROWS = 200_000  # node tables up to this size are broadcast when they meet rare grams
FREQUENT = 1 << 20
FLUSH_BYTES = 16 << 20  # of text, after which a task looks whether it holds too many keys
MERGE = 1 << 20
END_WORD = np.uint64(0x9E3779B97F4A7C15)  # stands for the end token among word hashes


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The context and symbol at each symbol (as u64), and where each text's symbols begin and end among them."""
    n = len(offsets) - 1
    z = np.full(len(raw) + (ORDER + 1) * n + ORDER, START, np.uint8)
    first = offsets[:-1] + (ORDER + 1) * np.arange(n)
    for a, b, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), strict=True):
        z[at + ORDER : at + ORDER + b - a] = raw[a:b]
        z[at + ORDER + b - a] = END
    size = len(z) - ORDER
    out = z[:size].astype(np.uint64)
    for k in range(1, ORDER + 1):
        out <<= np.uint64(8)
        out |= z[k : size + k]
    return out, first, first + np.diff(offsets) + 1


def _inside(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    mark = np.zeros(size + 1, np.int8)
    np.add.at(mark, first, 1)
    np.add.at(mark, last, -1)
    return np.cumsum(mark[:size]).astype(bool)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(k) else c


class Counts:
    """Counts of keys; what was added is merged whenever ``MERGE`` entries wait."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting >= MERGE:
            self.merge()

    def merge(self) -> int:
        k, c = _summed([np.zeros(0, np.uint64), *self.keys], [np.zeros(0, np.int64), *self.counts])
        self.keys, self.counts, self.waiting = [k], [c], 0
        return len(k)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: rows (kind, key, n), kind 0 for words and 1 for grams."""
    held = [Counts(), Counts()]

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        for kind, counts in enumerate(held):
            if counts.merge() > least:
                (k,), (c,) = counts.keys, counts.counts
                held[kind] = Counts()
                for a in range(0, len(k), 1 << 18):
                    part = k[a : a + (1 << 18)]
                    yield pa.record_batch([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(c[a : a + (1 << 18)])], names=["kind", "key", "n"])

    size = 0
    for part in slices(batches):
        raw, offsets = text_bytes(part.column("text"))
        h = word_hashes(raw, *words(raw, offsets)[:2])
        g, first, last = grams(raw, offsets)
        held[0].add(*np.unique(h, return_counts=True))
        held[0].add(np.array([END_WORD]), np.array([part.num_rows]))
        held[1].add(*np.unique(g[_inside(len(g), first, last)], return_counts=True))
        size += len(raw)
        if size >= FLUSH_BYTES:
            yield from flush(MERGE)
            size = 0
    yield from flush(0)
    give_back()


def _grade(n):
    """Counts graded by their logarithm, sixteen grades to a doubling: few grades, whatever the counts."""
    return F.floor(F.log2(F.col(n).cast("double")) * 16)


def _threshold(rows: DataFrame, most: int) -> int:
    """The smallest grade from which on at most ``most`` rows of ``rows(n)`` are left."""
    left, least = 0, 1 << 30
    for grade, rows_of in sorted(rows.groupBy(_grade("n").alias("g")).count().collect(), reverse=True):
        left += rows_of
        if left > most:
            break
        least = grade
    return least


def _sorted(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    got = rows.where(_grade("n") >= least).select("key", "n").toArrow()
    key, n = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(key.view(np.uint64))
    return key[order].view(np.uint64), n[order]


class Top:
    """Values of grams in an open hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, EMPTY, np.uint64)
        self.values = np.zeros(1 << self.bits, np.float32)
        left, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            self.probes += 1
            free = self.slots[slot] == EMPTY
            self.slots[slot[free]] = keys[left[free]]  # of several claims on a slot one wins
            won = self.slots[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each gram, 0 for those that are not here, and the places of these."""
        slot = self._slot(part)
        hit = self.slots[slot] == part
        value = np.where(hit, self.values[slot], np.float32(0)).astype(float)
        left = np.flatnonzero(~hit)
        at = slot[left]
        for _ in range(self.probes - 1):
            more = self.slots[at] != EMPTY
            left_on, at = left[more], (at[more] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at] == part[left_on]
            value[left_on[found]] = self.values[at[found]]
            hit[left_on[found]] = True
            left, at = left_on[~found], at[~found]
            if not len(left):
                break
        return value, np.flatnonzero(~hit)


def log10(top: Top, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The log10 probability of each text's grams that are in ``top``, and its others."""
    g, first, last = grams(raw, offsets)
    out = np.zeros(len(g) + 1)
    missing = []
    for a in range(0, len(g), 1 << 18):
        part = g[a : a + (1 << 18)]
        out[a : a + len(part)], missed = top.find(part)
        missing.append(a + missed)
    pairs = np.stack([first, last], 1).ravel()
    total = np.add.reduceat(out, pairs)[::2] if len(first) else np.zeros(0)
    at = np.concatenate([np.zeros(0, np.int64), *missing])
    return total, [g[at[x:y]] for x, y in zip(np.searchsorted(at, first).tolist(), np.searchsorted(at, last).tolist(), strict=True)]


def _tail(k: int):
    """The context of order k and the symbol of a gram."""
    return F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))


def _small(rows: DataFrame, order: int) -> DataFrame:
    """Broadcast a table whose keys have ``order`` bytes if they are two at most, or if it is counted to be small."""
    return F.broadcast(rows) if order <= 2 else sized_broadcast(rows, NODE_ROWS)


def trie(gram_rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """By order: the nodes ``(key, n)``, and per context the total, the distinct symbols, and what these symbols count
    one order below; checkpointed but for the lowest orders, which are made anew from a few thousand rows."""
    nodes = [gram_rows]
    for k in range(ORDER - 1, -1, -1):  # a node is the sum of those with one more byte in front
        rows = nodes[0].groupBy(_tail(k).alias("key")).agg(F.sum("n").alias("n"))
        nodes.insert(0, checkpoint(rows) if k > 1 else rows)
    sums = []
    for k in range(ORDER + 1):
        rows = nodes[k].withColumn("under", F.lit(0))
        if k:
            rows = nodes[k].withColumn("low", _tail(k - 1)).join(_small(nodes[k - 1].select(F.col("key").alias("low"), F.col("n").alias("under")), k), "low")
        rows = rows.groupBy(F.shiftright("key", 8).alias(f"c{k}")).agg(F.sum("n").alias(f"total{k}"), F.count(F.lit(1)).alias(f"distinct{k}"), F.sum("under").alias(f"under{k}"))
        sums.append(checkpoint(rows) if k > 2 else rows)
    return nodes, sums


def exact_values(asked: DataFrame, nodes: list[DataFrame], sums: list[DataFrame]) -> DataFrame:
    """The log10 probability, as ``value``, of each gram of ``asked(key)``, from the counts of every order."""
    for k in range(ORDER, -1, -1):
        node = nodes[k].select(F.col("key").alias(f"g{k}"), F.col("n").alias(f"n{k}"))
        asked = asked.withColumns({f"g{k}": _tail(k), f"c{k}": F.shiftright(_tail(k), 8)})
        asked = asked.join(_small(node, k + 1), f"g{k}", "left").join(_small(sums[k], k), f"c{k}", "left")
    value = -F.log10(F.lit(256) - F.coalesce("distinct0", F.lit(0)))
    for k in range(ORDER + 1):
        t, d = F.col(f"total{k}"), F.col(f"distinct{k}")
        if k < ORDER:
            t, d = F.coalesce(t - F.col(f"under{k + 1}"), t), F.coalesce(d - F.col(f"distinct{k + 1}"), d)
        escape = F.when(t + d > 0, F.log10(d / (t + d))).otherwise(0.0)
        value = F.when(F.col(f"n{k}").isNotNull(), F.log10(F.col(f"n{k}") / (t + d))).otherwise(value + escape)
    return asked.select("key", value.alias("value"))


def frequent_values(gram_rows: DataFrame, sums: list[DataFrame], most: int) -> DataFrame:
    """The values of the grams from the smallest grade of counts on that leaves at most ``most``; these need no escape."""
    often = gram_rows.where(_grade("n") >= _threshold(gram_rows, most)).withColumn(f"c{ORDER}", F.shiftright("key", 8))
    value = F.log10(F.col("n") / (F.col(f"total{ORDER}") + F.col(f"distinct{ORDER}")))
    return often.join(sums[ORDER], f"c{ORDER}").select("key", value.alias("value"))


def adaptive_log10(text: str | None, order: int = ORDER) -> float:
    """The log10 probability of one text under a model that starts empty and learns each byte after coding it."""
    data = bytes([START] * order) + (text or "").encode() + bytes([END])
    tree: dict[bytes, dict[int, int]] = {}
    total = 0.0
    for i in range(order, len(data)):
        s, gone = data[i], set()
        for k in range(order, -1, -1):
            seen = {x: n for x, n in tree.get(data[i - k : i], {}).items() if x not in gone}
            if not seen:
                continue
            den = sum(seen.values()) + len(seen)
            if s in seen:
                total += math.log10(seen[s] / den)
                break
            total += math.log10(len(seen) / den)
            gone |= seen.keys()
        else:
            total -= math.log10(256 - len(gone))
        for k in range(order + 1):
            node = tree.setdefault(data[i - k : i], {})
            node[s] = node.get(s, 0) + 1
    return total


def _scored(model, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, (known, log_count) = model.value, frequent.value
        for part in slices(batches):
            raw, offsets = text_bytes(part.column("text"))
            starts, ends, at = words(raw, offsets)
            h = word_hashes(raw, starts, ends)
            if len(known):
                j = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[j] == h
            else:
                j, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            sums = np.concatenate(([0.0], np.cumsum(np.where(hit, log_count[j] if len(known) else 0.0, 0.0))))
            hits = np.concatenate(([0], np.cumsum(hit)))
            rare, rare_n = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                k, c = np.unique(h[a:b][~hit[a:b]], return_counts=True)
                rare.append(k.tobytes())
                rare_n.append(c.astype(np.int32).tobytes())
            total, missing = log10(top, raw, offsets)
            other = [np.unique(m, return_counts=True) for m in missing]
            cols = [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(at) + 1), pa.array(hits[at[1:]] - hits[at[:-1]]), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(total), pa.array(rare, pa.binary()), pa.array(rare_n, pa.binary())]
            cols += [pa.array([k.astype(np.int64).tobytes() for k, _ in other], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in other], pa.binary())]
            yield pa.record_batch(cols, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "rare_n", "grams", "grams_n"])

    return run


def _rare_rows(name: str):
    """Rows (row, key, times) of the keys packed in the columns ``name`` and ``name_n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(name)]
            if sum(map(len, keys)):
                counts = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(f"{name}_n")]
                rows = np.repeat(batch.column("row").to_numpy(), [len(k) for k in keys])
                yield pa.record_batch([pa.array(rows), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], names=["row", "key", "times"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = light_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(7, 2))
    train = docs.where("doc_id is not null and not held_out").select("text")
    counted = checkpoint(train.mapInArrow(_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    word_rows, gram_rows = (counted.where(F.col("kind") == k).select("key", "n") for k in (0, 1))

    nodes, sums = trie(gram_rows)
    often = frequent_values(gram_rows, sums, FREQUENT_GRAMS).toArrow()
    model = spark.sparkContext.broadcast(Top(often["key"].to_numpy().view(np.uint64), often["value"].to_numpy()))

    n_train, n_words = word_rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = _threshold(word_rows, FREQUENT)
    known, n = _sorted(word_rows, least)
    frequent = spark.sparkContext.broadcast((known, np.log10(n + 1.0)))

    scored = checkpoint(docs.mapInArrow(_scored(model, frequent), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare binary, rare_n binary, grams binary, grams_n binary"))
    rest = word_rows.where(_grade("n") < least)
    found = scored.select("row", "rare", "rare_n").mapInArrow(_rare_rows("rare"), "row long, key long, times int").join(rest, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more_base"))
    end = word_rows.where(F.col("key") == int(END_WORD.astype(np.int64))).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()[0]
    tokens = F.col("n_tokens")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(math.log10(end + 1)) - tokens * F.lit(math.log10(n_train + n_words + 1))
    scored = scored.join(found, "row", "left")
    others = checkpoint(scored.select("row", "grams", "grams_n").mapInArrow(_rare_rows("grams"), "row long, key long, times int"))
    values = exact_values(others.select("key").distinct(), nodes, sums)
    scored = scored.join(others.join(values, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more_score")), "row", "left")
    value = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(int(end > 0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), value.alias("score")
    )
