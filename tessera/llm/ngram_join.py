"""Exact n-gram Jaccard self-join of documents by skipping over set relations.

Method.  Each document is the set of its distinct 5-word shingles; two documents link when their Jaccard
similarity is at least 0.75.

1. *Equal sets* collapse into one class (a relation that needs no join); a class goes on by its smallest doc_id.
2. *Leaders*: a few min-hash keys propose for each class one highly similar class.  Each proposal is verified
   exactly on whole sets.  Verified links make clusters of highly similar sets.
3. *Index-level skipping*: an exact prefix index.  Shingles are ordered by (document frequency if frequent, hash); of a
   set of n shingles, the first n - ceil(0.75 n) + 1 are posted with size, position and cluster.  Each list is sorted by
   size and cut into blocks that keep their size range and their smallest position, so that whole blocks are
   skipped by size or position; list entries of one cluster skip each other.  A list longer than a block limit, by the
   frequency known before or by its true length, is split over cells of a triangle, so no task holds a whole hot list.
   Remaining candidates are verified exactly.
4. *Answer-level skipping*: inside a cluster no pair of texts is compared.  Each set is described by its difference from
   one central set L (d shingles lack, a are added), computed once; an overlap is then |L| - d - d' + s, where s counts
   what two differences share.  Pairs that link even with s = 0 are only counted, by sums over a histogram of the
   differences' sizes.  For the others, blocks of sets whose differences are too small or too large are skipped whole,
   and the rest get s from the differences alone, block against block.  No pair is written out.

Components of all links give ``component_id``; ``n_links`` counts a document's links.

The frequency table only steers the order, never the result; it starts at the smallest count that leaves at most
2^21 entries, so it may be broadcast.

Edge cases.  Null, empty or all-space text: no shingles, links with nothing.  Fewer than five words: the whole
sequence is the one shingle.  Rows that share a doc_id are one node of the link graph, whatever their texts (each row is
returned, with the links of its own text).  A null doc_id takes no part in links; its row has a null component_id.  Other
columns are ignored, whatever their names.  Empty tables give no rows.  Shingles, and sets, are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SHINGLE_MUL, U64, checkpoint, components, drop_finished, few, give_back, light_batches, mix, parallelism, shingle_sets, signed, sized_broadcast, slices

WIDTH, SIMILARITY = 5, Fraction(3, 4)
KEYS = 6  # min-hash keys a class proposes leaders by
FREQUENT_BOUND = 1 << 21
GRADES = 8 * 64
HEAD_BITS = 40  # of a shingle's hash, which its frequency is counted by
GROUP_HEADS = 1 << 22  # heads counted in one group, or so
LIST_BLOCK = 64
CELL_ROWS = 2048
CELLS = 1 << 31  # more blocks than a list can have
SPREAD = 256  # pairs of one text that go to one task
BLOCK_COST = 256  # sets (with small differences) in a block of a cluster
COLUMNS = 4096  # shingles of a step when differences meet


def _min_needed(n: int, similarity: Fraction) -> int:
    """The least overlap of a set of n with any partner: ceil(similarity * n)."""
    return -(-similarity.numerator * n // similarity.denominator)


def _needed(a, b, similarity: Fraction):
    """The least overlap of sets of a and b: Jaccard >= p/q iff overlap * (p + q) >= p * (a + b)."""
    p, q = similarity.numerator, similarity.denominator
    return -(-p * (a + b) // (p + q))


def _identity(s: np.ndarray) -> np.uint64:
    """What names a set: the sum of its hashes."""
    return s.sum(dtype=np.uint64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), width)
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
            at = np.concatenate(([0], np.cumsum(n)))[:-1]
            live = n > 0
            cols = [part.column("doc_id"), pa.array(n)]
            for k in range(2 + KEYS):
                v = flat if k == 0 else mix(flat ^ SHINGLE_MUL[k])
                got = np.zeros(len(n), np.uint64)
                if live.any():
                    v = v[:-1]
                    got[live] = (np.add if k < 2 else np.minimum).reduceat(v, at[live])
                cols.append(signed(got))
            yield pa.record_batch(cols, names=["doc_id", "n", "cid", "check", *(f"m{k}" for k in range(KEYS))])
        give_back()

    return run


def _frequencies(width: int, bits: int):
    """Sorted heads of all shingles of a few million at a time, cut by their first ``bits`` bits; as three planes."""

    def pack(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        heads = np.sort(np.concatenate(sets) >> U64(64 - HEAD_BITS))
        cut = np.searchsorted(heads >> U64(HEAD_BITS - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        rows = [(p, heads[a:b]) for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
        planes = [pa.array([(h >> U64(shift)).astype(kind).tobytes() for _, h in rows], pa.binary()) for shift, kind in ((24, np.uint16), (8, np.uint16), (0, np.uint8))]
        yield pa.record_batch([pa.array([p for p, _ in rows], pa.int32()), *planes], names=["p", "high", "mid", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), width)
            held += sets
            size += sum(map(len, sets))
            if size >= 2_000_000:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)
        held = []
        give_back()

    return run


def _grade(count: np.ndarray) -> np.ndarray:
    """Counts graded by their logarithm, eight grades to a doubling; 1, 2, 3 and 4 have grades of their own."""
    return np.floor(np.log2(count) * 8).astype(np.int64)


_COUNTED = pa.schema([("head", pa.binary()), ("df", pa.binary()), ("hist", pa.list_(pa.int64()))])


def _counted(group: pa.Table) -> pa.Table:
    """One group's shingle heads that occur twice or more, with their counts, and how many have each grade."""
    planes = [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group[name]]).astype(np.uint64) << U64(shift) for name, shift, kind in (("high", 24, np.uint16), ("mid", 8, np.uint16), ("low", 0, np.uint8))]
    heads = np.sort(planes[0] | planes[1] | planes[2])
    at = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
    count = np.diff(np.append(at, len(heads)))
    keep = count > 1
    hist = np.bincount(_grade(count), minlength=GRADES)
    return pa.table({"head": [heads[at][keep].tobytes()], "df": [count[keep].astype(np.uint32).tobytes()], "hist": [hist.tolist()]}, _COUNTED)


def _at_least(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("head"), batch.column("df"), strict=True):
                df = np.frombuffer(c.as_buffer(), np.uint32)
                keep = _grade(df) >= least
                yield pa.record_batch([pa.array([np.frombuffer(h.as_buffer(), np.uint64)[keep].tobytes()], pa.binary()), pa.array([df[keep].tobytes()], pa.binary())], names=["head", "df"])

    return run


def _frequencies_of(docs: DataFrame, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle heads from the smallest grade of counts on that leaves at most ``FREQUENT_BOUND`` of them, sorted; their counts."""
    bits = min(24, max(8, (total // GROUP_HEADS).bit_length()))
    counted = checkpoint(docs.mapInArrow(_frequencies(width, bits), "p int, high binary, mid binary, low binary").groupBy("p").applyInArrow(_counted, "head binary, df binary, hist array<long>"))
    hist = np.zeros(GRADES, np.int64)
    for count, n in counted.select(F.posexplode("hist")).groupBy("pos").agg(F.sum("col")).collect():
        hist[count] = n
    above = np.cumsum(hist[::-1])[::-1]
    fits = np.flatnonzero(above <= FREQUENT_BOUND)
    least = max(int(_grade(np.array([2]))[0]), int(fits[0])) if len(fits) else GRADES
    kept = counted.mapInArrow(_at_least(least), "head binary, df binary").toArrow()
    heads, df = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in kept[c] if x.as_py())]) for c, kind in (("head", np.uint64), ("df", np.uint32)))
    order = np.argsort(heads)
    return heads[order], df[order]


def _postings(width: int, similarity: Fraction, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, counts = frequent.value
        for part in slices(batches):
            told = part.column("told").to_pylist()
            tokens, docs, clusters, sizes, places, lists = [], [], [], [], [], []
            for i, s in enumerate(shingle_sets(part.column("text"), width)):
                n = len(s)
                if not n:
                    continue
                cid = int(_identity(s).astype(np.int64))
                label = cid
                if told[i]:
                    mine = [t for t in told[i] if t["cid"] == cid]
                    if mine:
                        if not mine[0]["post"]:
                            continue
                        label = mine[0]["label"]
                df = np.zeros(n, np.int64)
                if len(heads):
                    h = s >> U64(64 - HEAD_BITS)
                    j = np.minimum(np.searchsorted(heads, h), len(heads) - 1)
                    df = np.where(heads[j] == h, counts[j], 0).astype(np.int64)
                    if df.any():
                        order = np.argsort(df, kind="stable")
                        s, df = s[order], df[order]
                k = n - _min_needed(n, similarity) + 1
                tokens.append(s[:k])
                lists.append(df[:k])
                docs.append(np.full(k, cid))
                clusters.append(np.full(k, label))
                sizes.append(np.full(k, n, np.int32))
                places.append(np.arange(k, dtype=np.int32))
            if tokens:
                token, df, doc = np.concatenate(tokens), np.concatenate(lists), np.concatenate(docs)
                blocks = np.maximum(1, -(-df // CELL_ROWS)).astype(np.int32)
                mine = (mix(doc.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int32)
                # The label is sent as what sets it apart from the name: 0 for most, which takes no room in a shuffle.
                cols = [token.view(np.int64), doc, np.concatenate(clusters) ^ doc, np.concatenate(sizes), np.concatenate(places), mine]
                cell = np.zeros(len(token), np.int64)
                if (blocks > 1).any():  # a long list: each entry meets each of the list's blocks in one cell
                    back = np.repeat(np.arange(len(token)), blocks)
                    other = (np.arange(len(back)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(np.int32)
                    cols = [c[back] for c in cols]
                    cell = np.where(blocks[back] > 1, 1 + np.minimum(cols[5], other).astype(np.int64) * CELLS + np.maximum(cols[5], other), 0)
                yield pa.record_batch([pa.array(c) for c in (*cols, cell)], names=["token", "doc", "label", "n", "pos", "block", "cell"])
        give_back()

    return run


POSTING = "token long, doc long, label long, n int, pos int, block int, cell long"


def _list_pairs(doc, label, n, pos, block, diagonal: bool, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of one list, sorted by size: blocks are skipped whole by size, then by position."""
    order = np.argsort(n, kind="stable")
    doc, label, n, pos, block = doc[order], label[order], n[order].astype(np.int64), pos[order].astype(np.int64), block[order]
    p, q = similarity.numerator, similarity.denominator
    until = np.searchsorted(n, n * q // p, side="right")  # partners that are larger at most
    size, left, right = len(n), [], []
    rest = n - pos  # tokens from this one on
    for a in range(0, size, LIST_BLOCK):
        b = min(a + LIST_BLOCK, size)
        for c in range(a, int(until[b - 1]), LIST_BLOCK):
            d = min(c + LIST_BLOCK, size)
            if min(rest[a:b].max(), rest[c:d].max()) < _needed(int(n[a]), int(n[c]), similarity):
                continue
            x, y = n[a:b, None], n[None, c:d]
            ok = (np.minimum(rest[a:b, None], rest[None, c:d]) >= _needed(x, y, similarity)) & (label[a:b, None] != label[None, c:d]) & (np.arange(a, b)[:, None] < np.arange(c, d)[None, :])
            if not diagonal:
                ok &= block[a:b, None] != block[None, c:d]
            i, j = np.nonzero(ok)
            left.append(doc[a + i])
            right.append(doc[c + j])
    return (np.concatenate(left), np.concatenate(right)) if left else (doc[:0], doc[:0])


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("doc", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _candidates(similarity: Fraction, most: int | None = None):
    """Pairs (a, b) of the lists of a partition; lists longer than ``most`` that were not split are given back as rows."""

    def pairs(x: np.ndarray) -> pa.RecordBatch:
        low, high = (pa.array(np.ascontiguousarray(x[:, i])) for i in (0, 1))
        return pa.RecordBatch.from_arrays([low, high, *(pa.nulls(len(x), f.type) for f in list(_FOUND)[2:])], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        token, doc, apart, n, pos, block, cell = (t[c].to_numpy() for c in ("token", "doc", "label", "n", "pos", "block", "cell"))
        label = apart ^ doc
        del t
        order = np.lexsort((cell, token)) if cell.any() else np.argsort(token)
        token, cell = token[order], cell[order]
        at = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1]))))
        end = np.append(at[1:], len(token))
        lab = label[order]
        live = np.flatnonzero(np.minimum.reduceat(lab, at) != np.maximum.reduceat(lab, at))  # lists inside one cluster are done
        seen, held = np.zeros((0, 2), np.int64), []
        for g in live.tolist():
            o = order[at[g] : end[g]]
            if most and len(o) > most and not cell[at[g]]:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(o), pa.int64()), pa.nulls(len(o), pa.int64()), pa.array(token[at[g] : end[g]]), *(pa.array(c[o]) for c in (doc, apart, n, pos))], schema=_FOUND)
                continue
            w = int(cell[at[g]]) - 1
            a, b = _list_pairs(doc[o], label[o], n[o], pos[o], block[o], w < 0 or w // CELLS == w % CELLS, similarity)
            if len(a):
                held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            if sum(map(len, held)) > 500_000:
                seen, held = np.unique(np.concatenate([seen, *held]), axis=0), []
                if len(seen) > 2_000_000:
                    yield pairs(seen)
                    seen = seen[:0]
        yield pairs(np.unique(np.concatenate([seen, *held]), axis=0))
        del token, doc, label, apart, n, pos, block, cell, order, lab, seen
        give_back()

    return run


def _met(postings: DataFrame, total: int, similarity: Fraction) -> DataFrame:
    """Candidates (a, b) of all lists; long ones that the frequencies did not tell are dealt over cells by their length."""
    parts = max(parallelism(postings.sparkSession), -(-total // 1_000_000))
    schema = "a long, b long, token long, doc long, label long, n int, pos int"
    found = checkpoint(postings.repartition(parts, "token", "cell").mapInArrow(_candidates(similarity, 2 * CELL_ROWS), schema))
    late = found.where("token is not null").select("token", "doc", "label", "n", "pos")
    blocks = late.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("blocks"))
    dealt = late.join(blocks, "token").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.least("block", "other").cast("long") * F.lit(CELLS) + F.greatest("block", "other") + 1
    more = dealt.select("token", "doc", "label", "n", "pos", "block", cell.alias("cell")).repartition(parts, "token", "cell").mapInArrow(_candidates(similarity), schema)
    return checkpoint(found.where("token is null").select("a", "b").union(more.select("a", "b")).distinct())


def _meetings(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of ``pairs(a, ra, b, rb)`` of set names and doc_ids, in the order ``_both`` reads: each text of a ``ra``
    once, and behind it those of its partners.  A text of many pairs is dealt over salts."""
    salts = F.ceil(F.count(F.lit(1)) / SPREAD).cast("int")
    n = pairs.count()
    pairs = few(pairs, n)
    firsts = checkpoint(few(pairs.groupBy("ra").agg(salts.alias("salts")), n))
    seconds = few(pairs.select(F.col("rb").alias("doc_id")).distinct(), n)
    texts = docs.join(sized_broadcast(checkpoint(few(firsts.select(F.col("ra").alias("doc_id")).union(seconds).distinct(), 2 * n))), "doc_id", "left_semi")
    left = texts.join(sized_broadcast(firsts), F.col("doc_id") == F.col("ra")).select("ra", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    salted = pairs.join(sized_broadcast(firsts), "ra").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    right = salted.join(texts.withColumnRenamed("doc_id", "rb"), "rb").select("ra", "salt", F.lit(1), "a", "b", "text")
    return left.union(right).repartition("ra", "salt").sortWithinPartitions("ra", "salt", "kind").select("ra", "kind", "a", "b", "text")


def _both(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[int], list[int], list[np.ndarray], list[np.ndarray]]]:
    """Names and sets of the pairs of ``_meetings``; a text that is not the set named (another of its doc_id) is left out."""
    at, held = None, {}  # the sets of the doc_id whose partners follow
    for part in slices(batches, "text", 1 << 20):
        ids, kinds, first, second = (part.column(c).to_pylist() for c in ("ra", "kind", "a", "b"))
        out: tuple[list, ...] = ([], [], [], [])
        for i, s in enumerate(shingle_sets(part.column("text"), width)):
            if ids[i] != at:
                at, held = ids[i], {}
            if not len(s):
                continue
            name = int(_identity(s).astype(np.int64))
            if not kinds[i]:
                held[name] = s
            elif name == second[i] and first[i] in held:
                for column, value in zip(out, (first[i], name, held[first[i]], s), strict=True):
                    column.append(value)
        if out[0]:
            yield out


def _overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x are in y (both sorted, y not empty)."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _linked(width: int, similarity: Fraction):
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, second, left, right in _both(batches, width):
            keep = []
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                both = int(_overlap(x, y).sum())
                if q * both >= p * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.record_batch([pa.array([side[i] for i in keep], pa.int64()) for side in (first, second)], names=["a", "b"])
        give_back()

    return run


def _verify(docs: DataFrame, pairs: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """Of the proposed ``pairs(a, ra, b, rb)`` those that link, checked on the whole sets of both texts."""
    return _meetings(docs, pairs).mapInArrow(_linked(width, similarity), "a long, b long").distinct()


def _differences(width: int):
    """For each pair of a central set a and a set b: the places in a that b lacks, and the shingles that it adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, second, left, right in _both(batches, width):
            lacks = [np.flatnonzero(~_overlap(x, y)).astype(np.uint32) for x, y in zip(left, right, strict=True)]
            adds = [y[~_overlap(y, x)] for x, y in zip(left, right, strict=True)]
            cols = [pa.array(second, pa.int64()), pa.array([len(x) for x in left], pa.int64()), pa.array([len(v) for v in lacks], pa.int64()), pa.array([len(v) for v in adds], pa.int64()), pa.array([v.tobytes() for v in lacks], pa.binary()), pa.array([v.tobytes() for v in adds], pa.binary())]
            yield pa.record_batch(cols, names=["cid", "whole", "d", "a", "lacks", "adds"])
        give_back()

    return run


_MORE = pa.schema([("cid", pa.int64()), ("more", pa.int64())])


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each list on the left shares with each on the right: products of indicator matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate([np.zeros(0, np.uint64), *side]) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in (left, right)]
    common = np.intersect1d(*flat)
    if not len(common):
        return out
    places = []
    for values in flat:
        j = np.minimum(np.searchsorted(common, values), len(common) - 1)
        places.append(np.where(common[j] == values, j, -1))
    for a in range(0, len(common), COLUMNS):
        wide = min(COLUMNS, len(common) - a)
        sides = []
        for side, at, row in zip((left, right), places, rows, strict=True):
            x, pick = np.zeros((len(side), wide), np.float32), (at >= a) & (at < a + wide)
            x[row[pick], at[pick] - a] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def _block_links(similarity: Fraction):
    """Two blocks of a cluster's sets: for each set the rows of the sets of the other block that it links with, but for
    the pairs that are sure to link (which are counted elsewhere)."""
    twice = 2 * (similarity.numerator + similarity.denominator)

    def run(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        sides = []
        for k in (0, 1) if (side == 1).any() else (0, 0):
            part = group.filter(pa.array(side == k))
            # Places in the central set and added shingles do not meet: the former are small numbers, marked by a bit.
            sets = [np.concatenate([np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64), np.frombuffer(y.as_buffer(), np.uint64) | U64(1 << 63)]) for x, y in zip(part["lacks"], part["adds"], strict=True)]
            sides.append((part["cid"].to_numpy(), part["w"].to_numpy(), part["size"].to_numpy(), sets))
        (ids, w, size, sets), (ids2, w2, size2, sets2) = sides
        gap = w[:, None] + w2[None, :]
        link = (gap < 0) & (gap + twice * _shared(sets, sets2).astype(np.int64) >= 0)
        if not (side == 1).any():
            np.fill_diagonal(link, False)
            return pa.table([ids, (link * size2[None, :]).sum(axis=1)], schema=_MORE)
        return pa.table([np.concatenate([ids, ids2]), np.concatenate([(link * size2[None, :]).sum(axis=1), (link * size[:, None]).sum(axis=0)])], schema=_MORE)

    return run


def _cluster_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, near: DataFrame, count: int, width: int, similarity: Fraction) -> DataFrame:
    """(cid, more): rows of other sets of the same cluster that each set links with, from differences alone; there are
    ``count`` sets at most."""
    p, q = similarity.numerator, similarity.denominator
    known = classes.select("cid", "rep", "size", "n")
    members = few(few(clusters.union(clusters.select("component", "component")).distinct(), count).withColumnRenamed("id", "cid").join(known, "cid"), count)
    proposals = few(near.groupBy(F.col("a").alias("cid")).agg(F.count(F.lit(1)).alias("c")), count)
    centre = few(members.join(proposals, "cid", "left"), count).groupBy("component").agg(F.max(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "cid", "rep")).alias("x")).select("component", F.col("x.cid").alias("a"), F.col("x.rep").alias("ra"))
    pairs = checkpoint(few(members.join(sized_broadcast(checkpoint(few(centre, count))), "component"), count).withColumnsRenamed({"cid": "b", "rep": "rb"}))
    told = _meetings(docs, pairs.select("a", "ra", "b", "rb")).mapInArrow(_differences(width), "cid long, whole long, d long, a long, lacks binary, adds binary").dropDuplicates(["cid"])
    w = (p + q) * F.col("whole") - 2 * (p + q) * F.col("d") - 2 * p * F.col("n")
    cost = 1 + F.floor((F.col("d") + F.col("a")) / 64)
    rows = checkpoint(pairs.select(F.col("b").alias("cid"), "component", "size", "n").join(told, "cid").withColumns({"w": w, "cost": cost}))

    # A pair links for sure if w + w' >= 0.  Sums over the values of w, of which a cluster has no more than some
    # twenty times its central set's size.
    values = checkpoint(few(rows.groupBy("component", "w").agg(F.sum("size").alias("rows"), F.sum("cost").alias("cost")), count))
    falling = Window.partitionBy("component").orderBy(F.desc("x"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    asked = values.select("component", F.col("w").alias("x"), "rows", F.lit(False).alias("asks"), "w").union(values.select("component", -F.col("w"), F.lit(0), F.lit(True), "w"))
    sure = few(asked.withColumn("sure", F.sum("rows").over(falling)).where("asks").select("component", "w", "sure"), 2 * count)
    earlier = Window.partitionBy("component").orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    placed = checkpoint(few(values.withColumn("start", F.coalesce(F.sum("cost").over(earlier), F.lit(0))).withColumnRenamed("cost", "all").drop("rows").join(sure, ["component", "w"]), count))
    inside = F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = rows.join(sized_broadcast(placed), ["component", "w"]).withColumn("block", F.floor((F.col("start") + inside * F.col("all")) / BLOCK_COST).cast("int"))

    spans = checkpoint(few(rows.groupBy("component", "block").agg(F.min("w").alias("w0"), F.max("w").alias("w1"), F.max(F.col("d") + F.col("a")).alias("most"), F.min("n").alias("n0"), F.max("n").alias("n1")), count))
    other = spans.select("component", *(F.col(c).alias(f"{c}_") for c in ("block", "w0", "w1", "most", "n0", "n1")))
    cells = spans.join(other, "component").where("block <= block_")
    cells = cells.where(F.col("w0") + F.col("w0_") < 0).where(F.col("w1") + F.col("w1_") + 2 * (p + q) * F.least("most", "most_") >= 0)
    cells = cells.where((F.col("n1") * q >= F.col("n0_") * p) & (F.col("n1_") * q >= F.col("n0") * p)).select("component", "block", "block_")
    cells = checkpoint(cells.select("component", "block", "block_", F.lit(0).alias("side"), F.col("block").alias("mine")).union(cells.where("block != block_").select("component", "block", "block_", F.lit(1), "block_")))
    dealt = rows.select("cid", "component", F.col("block").alias("mine"), "w", "size", "lacks", "adds").join(sized_broadcast(cells), ["component", "mine"])
    more = dealt.groupBy("component", "block", "block_").applyInArrow(_block_links(similarity), "cid long, more long")
    surely = rows.select("cid", (F.col("sure") - F.when(F.col("w") >= 0, F.col("size")).otherwise(0)).alias("more"))
    return surely.union(more).groupBy("cid").agg(F.sum("more").alias("more"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, similarity: Fraction = SIMILARITY, links: bool = True) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, class_id (the smallest doc_id with the same
    set) and, unless ``links`` is off, n_links (the other rows with a doc_id whose texts link with this one's)."""
    spark = docs.sparkSession
    docs = light_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = ", ".join(f"m{k} long" for k in range(KEYS))
    rows = checkpoint(docs.mapInArrow(_signatures(width), f"doc_id long, n long, cid long, check long, {keys}"))
    count = rows.count()
    rows = few(rows, count)
    live = rows.where("n > 0 and doc_id is not null")
    classes = checkpoint(few(live.groupBy("cid", "check", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), *(F.first(f"m{k}").alias(f"m{k}") for k in range(KEYS))), count))
    known = docs.where("doc_id is not null")

    keyed = classes.select("cid", "rep", F.posexplode(F.array(*(f"m{k}" for k in range(KEYS)))).alias("k", "m"))
    leaders = few(keyed.groupBy("k", "m").agg(F.min(F.struct("rep", "cid")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), KEYS * count)
    # A class is compared with the leader that most of its keys propose, and with the others only if that one fails.
    proposals = few(keyed.join(leaders, ["k", "m"]).where("cid != lead.cid"), KEYS * count).groupBy(F.col("cid").alias("b"), F.col("rep").alias("rb"), "lead").agg(F.count(F.lit(1)).alias("keys"))
    proposals = few(proposals, KEYS * count)
    order = Window.partitionBy("b").orderBy(F.desc("keys"), "lead")  # no more rows than keys
    proposed = checkpoint(few(proposals.withColumn("place", F.row_number().over(order)).select(F.col("lead.cid").alias("a"), F.col("lead.rep").alias("ra"), "b", "rb", "place"), KEYS * count))
    near = checkpoint(few(_verify(known, proposed.where("place = 1").drop("place"), width, similarity), count))
    failed = proposed.where("place > 1").join(sized_broadcast(near.select("b")), "b", "left_anti").drop("place")
    near = checkpoint(few(near.union(_verify(known, checkpoint(few(failed, KEYS * count)), width, similarity)), KEYS * count))
    clusters = components(near)

    # Rows whose text needs no posting (equal to a smaller doc_id's) or carries a cluster's label; the rest stand for themselves.
    member = few(live.join(classes.select("cid", "check", "n", "rep"), ["cid", "check", "n"]), count).join(clusters.withColumnRenamed("id", "cid"), "cid", "left")
    member = checkpoint(few(member.select("doc_id", "cid", "rep", "component"), count))
    told = member.where("doc_id != rep or component is not null").groupBy("doc_id").agg(F.collect_set(F.struct("cid", (F.col("doc_id") == F.col("rep")).alias("post"), F.coalesce("component", "cid").alias("label"))).alias("told"))
    told = checkpoint(few(told, count))

    total = rows.agg(F.sum("n")).first()[0] or 0
    steer = spark.sparkContext.broadcast(_frequencies_of(known, width, total))
    drop_finished(spark)
    postings = known.join(sized_broadcast(told), "doc_id", "left").select("text", "told").mapInArrow(_postings(width, similarity, steer), POSTING)
    candidates = _met(postings, total, similarity)
    steer.unpersist()
    drop_finished(spark)
    named, met = classes.select("cid", "rep"), candidates.count()
    candidates = few(candidates, met)
    for x in "ab":
        candidates = few(candidates.join(named.withColumnsRenamed({"cid": x, "rep": f"r{x}"}), x), met)
    across = checkpoint(few(_verify(known, checkpoint(candidates), width, similarity), met))

    # Sets of one doc_id are one node.
    shared = member.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z"), F.collect_set("cid").alias("cids")).where("a != z").select("a", F.explode("cids").alias("b"))
    whole = components(near.union(across).union(shared))
    whole = few(whole.union(whole.select("component", "component")).distinct(), count)
    least = few(few(whole.join(named.withColumnRenamed("cid", "id"), "id"), count).groupBy("component").agg(F.min("rep").alias("component_id")), count)
    facts = classes.select("cid", "check", "n", "rep", "size").join(few(whole.join(least, "component"), count).select(F.col("id").alias("cid"), "component_id"), "cid", "left")
    facts = few(facts, count)
    if links:
        ends = few(across.union(across.select("b", "a")).join(classes.select(F.col("cid").alias("b"), "size"), "b"), 2 * met).select(F.col("a").alias("cid"), F.col("size").alias("more"))
        more = few(ends.union(_cluster_links(known, classes, clusters, near, count, width, similarity)), 2 * met + 2 * count).groupBy("cid").agg(F.sum("more").alias("more"))
        facts = few(facts.join(few(more, count), "cid", "left"), count).withColumn("n_links", F.col("size") - 1 + F.coalesce("more", F.lit(0)))
    else:
        facts = facts.withColumn("n_links", F.lit(None).cast("long"))
    parts = live.join(facts, ["cid", "check", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"), F.col("rep").alias("class_id"), "n_links")
    parts = checkpoint(few(parts, count))
    empty = rows.where("n = 0 or doc_id is null").select("doc_id", "n")
    nodes = few(parts.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), count)  # a doc_id may have other texts
    rest = empty.join(nodes, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id"), "doc_id", F.lit(0 if links else None).cast("long"))
    out = parts.union(rest)
    return out if links else out.drop("n_links")


#: The same rows by plain pairs and transitive closure, for tables whose doc_ids are known and occur once.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y, same FROM l UNION ALL SELECT y, x, same FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id,
       least(w.doc_id, coalesce((SELECT min(y) FROM e WHERE e.x = w.doc_id AND e.same), w.doc_id)) AS class_id, (SELECT count(*) FROM e WHERE e.x = w.doc_id) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
