"""Buckets that split: rows by the leading bits of a hash of their key, as many bits as a bucket's bytes ask for.

A bucket is named by its bits.  The buckets of a table are the leaves of a binary tree, so they cover all hashes once;
one that grows beyond its bytes is written as its halves, quarters and so on, and all others stay as they are.  Where a
hash belongs is read off a table with one byte, the depth, for each value of the deepest bucket's bits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No bucket splits further; a table of depths has at most a megabyte.
MOST_BITS = 20


def key_hash(*keys: Column | str) -> Column:
    return F.xxhash64(*keys)


def leading(hashed: Column, bits: int) -> Column:
    """The first bits of a hash as a number."""
    return F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("long")


def bucket_name(hashed: Column, buckets: Iterable[str]) -> Column:
    """The bucket of a hash; ``buckets`` are all there are (none: one without bits)."""
    names = list(buckets) or [""]
    deepest = max(map(len, names))
    if deepest == 0:
        return F.lit("")
    depths = bytearray(1 << deepest)
    for name in names:
        low = int(name or "0", 2) << (deepest - len(name))
        for i in range(low, low + (1 << (deepest - len(name)))):
            depths[i] = len(name)
    at = leading(hashed, deepest)
    depth = F.conv(F.hex(F.substring(F.lit(bytes(depths)), at.cast("int") + 1, 1)), 16, 10).cast("int")
    return F.substring(F.lpad(F.conv(at.cast("string"), 10, 2), deepest, "0"), F.lit(1), depth)


def split(name: str, size: int, most: int) -> list[str]:
    """The buckets that a bucket of ``size`` bytes becomes: itself, or parts of at most ``most`` bytes or so."""
    more = 0
    while size > most << more and len(name) + more < MOST_BITS:
        more += 1
    return [name + format(i, f"0{more}b") for i in range(1 << more)] if more else [name]
