"""Language identification by a byte convolutional network in numpy.

The network reads fixed-length windows of UTF-8 bytes (A-Z lower-cased): filters of several widths over one-hot bytes,
max pooling over the window, and a softmax layer.  A filter over one-hot bytes is a sum of table rows, one table for
each offset, so training touches only the rows at the pooled maxima, and prediction adds rows of byte-pair tables.
A document's distribution is the mean of its windows', by their length; every byte of the text is read.

Training uses a bounded sample of labelled documents: at most ``PER_LANGUAGE`` a language, and with many languages no
more of each than make ``MOST_TEXTS`` together (one at least); the first by a hash of doc_id, rows of one doc_id and
language counting once.  Every window of their whole texts, however short or long, is learned from.  A document's windows share its
weight, so long ones do not outvote short ones.  Everything else covers all rows.

Edge cases.  Null text, and text without a letter, is ``und`` with score 0; such rows are not learned from.  Without
any other labelled row everything is ``und``.  A null doc_id is not held out and not learned from.  Repeated rows give
repeated rows; of a doc_id with several texts in one language the first by its bytes is learned from.  Of languages with equal
probability the first by code point is told.  Null languages are not learned from.  Other columns are ignored, whatever their names; lang, source and doc_id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, checkpoint, give_back, light_batches, sized_broadcast, slices, text_bytes

WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS = 8
PER_LANGUAGE = 300
MOST_TEXTS = 20_000
EPOCHS = 6
BATCH = 64
UND = "und"


class ByteNet:
    """Tables[w][k]: the filters' weights of width w at offset k, for each byte."""

    def __init__(self, classes: list[str], widths: tuple[int, ...] = WIDTHS, filters: int = FILTERS, seed: int = 1):
        r = np.random.Generator(np.random.PCG64(seed))
        self.classes, self.widths, self.filters = classes, widths, filters
        self.tables = [r.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        self.bias = [np.zeros(filters, np.float32) for _ in widths]
        self.dense = r.normal(0, 0.3, (len(widths) * filters, len(classes))).astype(np.float32)
        self.out = np.zeros(len(classes), np.float32)
        self._pairs: list[list[np.ndarray]] | None = None

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 2, weights_of: np.ndarray | None = None) -> ByteNet:
        """Minimise (weighted) cross entropy with Adam over shuffled batches."""
        share = np.ones(len(windows), np.float32) if weights_of is None else weights_of.astype(np.float32)
        r = np.random.Generator(np.random.PCG64(seed))
        weights = [*self.tables, *self.bias, self.dense, self.out]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step, f = 0, self.filters
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                x, y = windows[order[a : a + BATCH]], labels[order[a : a + BATCH]]
                n = len(x)
                best, pooled = [], []
                for w, table, bias in zip(self.widths, self.tables, self.bias, strict=True):
                    size = x.shape[1] - w + 1
                    maps = sum(table[k][x[:, k : k + size]] for k in range(w)) + bias
                    at = maps.argmax(axis=1)
                    best.append(at)
                    pooled.append(np.take_along_axis(maps, at[:, None], 1)[:, 0])
                raw = np.concatenate(pooled, axis=1)
                hidden = np.maximum(raw, 0)
                logits = hidden @ self.dense + self.out
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), y] -= 1
                p *= share[order[a : a + BATCH], None] / n
                back = (p @ self.dense.T) * (raw > 0)
                grads = [np.zeros_like(t) for t in self.tables]
                rows = np.arange(n)[:, None]
                for j, w in enumerate(self.widths):
                    g = back[:, j * f : (j + 1) * f]
                    for k in range(w):
                        np.add.at(grads[j], (k, x[rows, best[j] + k], np.arange(f)[None, :]), g)
                grads += [back[:, j * f : (j + 1) * f].sum(axis=0) for j in range(len(self.widths))]
                grads += [hidden.T @ p, p.sum(axis=0)]
                step += 1
                for weight, grad, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    weight -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self._pairs = None
        return self

    def _pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, the summed rows of two neighbouring bytes: [first, second] -> filters."""
        if self._pairs is None:
            self._pairs = [[(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, w, 2)] for w, t in zip(self.widths, self.tables, strict=True)]
        return self._pairs

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """The softmax of each window; widths must be even, as byte pairs are looked up."""
        tables = self._pair_tables()
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for a in range(0, len(windows), 512):
            x = windows[a : a + 512].astype(np.int32)
            pair = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for w, parts, bias in zip(self.widths, tables, self.bias, strict=True):
                size = x.shape[1] - w + 1
                maps = np.take(parts[0], pair[:, :size], axis=0)
                for k, part in enumerate(parts[1:], 1):
                    maps += np.take(part, pair[:, 2 * k : 2 * k + size], axis=0)
                pooled.append(maps.max(axis=1) + bias)
            logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.out
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[a : a + 512] = p / p.sum(axis=1, keepdims=True)
        return out


def cut(raw: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (zero-padded rows), the text each belongs to, and its number of bytes; none for an empty text."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), counts)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
    used = np.minimum(lengths[text] - start, size)
    padded = np.concatenate([LOWER[raw], np.zeros(size, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, size)[offsets[:-1][text] + start] if len(text) else np.zeros((0, size), np.uint8)
    rows = np.where(np.arange(size)[None, :] < used[:, None], rows, 0).astype(np.uint8)
    return rows, text, used


def _has_letter(raw: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    low = raw | 0x20
    seen = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return found


def _predict(net: ByteNet | None, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text")
            raw, offsets = text_bytes(texts)
            name, score = np.full(len(texts), UND, object), np.zeros(len(texts))
            if net:
                rows, text, used = cut(raw, offsets)
                p = net.probabilities(rows) * used[:, None].astype(np.float32)
                total = np.zeros((len(texts), len(net.classes)))
                if len(text):
                    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                    total[text[first]] = np.add.reduceat(p.astype(np.float64), first, axis=0)
                total /= np.maximum(1, np.diff(offsets))[:, None]
                known = _has_letter(raw, offsets, texts)
                best = total.argmax(axis=1)
                name[known] = np.array(net.classes, object)[best[known]]
                score[known] = np.clip(total[known, best[known]], 0, 1)
            yield pa.record_batch([*(part.column(c) for c in keep), pa.array(name, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])
        give_back()

    return run


def held_out(modulus: int, remainder: int):
    doc = F.col("doc_id").cast("long").cast("string").cast("binary")
    return F.coalesce(F.crc32(doc) % modulus == remainder, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_TEXTS) -> DataFrame:
    """The labelled documents to learn from, each once: lang, doc_id, text."""
    usable = docs.where("doc_id is not null and lang is not null").where(F.regexp_like("text", F.lit(r"\p{L}"))).where(~held_out(4, 2))
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30))
    rows = usable.select("doc_id", "lang", h.alias("h")).distinct()
    counts = checkpoint(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    per_language = max(1, min(per_language, most // max(1, counts.count())))
    # Each language's share of hashes that holds some four times as many documents as are wanted goes to the ranking.
    share = counts.select("lang", (F.lit(4.0 * per_language + 100) / F.col("n")).alias("share"))
    near = rows.join(sized_broadcast(share), "lang").where(F.col("h") < F.col("share") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = near.withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id", "lang")
    chosen = usable.join(sized_broadcast(checkpoint(ids)), ["doc_id", "lang"], "left_semi").select("lang", "doc_id", F.col("text").cast("string").alias("text"))
    return chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> ByteNet | None:
    """A network from ``docs(doc_id, text, lang)`` outside the held-out fold; None without labelled text."""
    got = training_sample(docs, per_language).orderBy("lang", "doc_id").toArrow()
    classes = sorted(set(got["lang"].to_pylist()))
    if not classes:
        return None
    where = {c: i for i, c in enumerate(classes)}
    labels = np.array([where[c] for c in got["lang"].to_pylist()])
    windows, text, used = cut(*text_bytes(got["text"].combine_chunks()))
    # A document's weight is dealt over its windows by their length; the mean weight of a window is 1.
    weight = used / np.bincount(text, used)[text]
    return ByteNet(classes).fit(windows, labels[text], epochs, weights_of=weight * len(weight) / len(labels))


def predict(docs: DataFrame, net: ByteNet | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (with ``text``): the columns ``keep``, lang_pred and score."""
    rows = light_batches(docs).select(*keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(_predict(net, tuple(keep)), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows outside the held-out fold, then predict every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(4, 2).alias("held_out"))
    return predict(rows, train(docs), ("doc_id", "held_out"))
