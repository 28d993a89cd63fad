"""Checks and limits: override resolution, batch packing, retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def override(value: int | None, default: int, name: str) -> int:
    """A request's override: none gives the default, zero is an error."""
    if value is None:
        return default
    if value == 0:
        raise ValueError(f"{name} must be greater than zero")
    return value


def override_column(value: Column | str, default: int, name: str) -> Column:
    """The same for a batch of requests: an error as soon as a row asks for zero."""
    x = col(value)
    ok = F.assert_true(x.isNull() | (x != 0), F.lit(f"{name} must be greater than zero"))
    return F.when(ok.isNull(), F.coalesce(x, F.lit(default)))


def pack_ranges(counts: Column | str, max_tokens: int, max_items: int) -> Column:
    """Cut an array of token counts into consecutive batches under both limits: array of (first, until)."""
    state = "struct<first:int,at:int,tokens:bigint,done:array<struct<first:int,until:int>>>"
    start = F.from_json(F.lit('{"first":0,"at":0,"tokens":0,"done":[]}'), state)

    def step(s: Column, n: Column) -> Column:
        full = (s["at"] > s["first"]) & ((s["tokens"] + n > max_tokens) | (s["at"] - s["first"] >= max_items))
        done = F.when(full, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["at"].alias("until"))))).otherwise(s["done"])
        return F.struct(F.when(full, s["at"]).otherwise(s["first"]).alias("first"), (s["at"] + 1).alias("at"), (F.when(full, F.lit(0)).otherwise(s["tokens"]) + n).cast("bigint").alias("tokens"), done.alias("done"))

    def finish(s: Column) -> Column:
        return F.when(s["at"] > s["first"], F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["at"].alias("until"))))).otherwise(s["done"])

    return F.aggregate(F.transform(col(counts), lambda x: x.cast("bigint")), start, step, finish)


def valid_embedding_input(text: Column | str, tokens: Column | str, most: int = 8192) -> Column:
    """Whether a text may be embedded: not empty and within the token limit."""
    return (F.length(col(text)) > 0) & (col(tokens) <= most)


def backoff_ms(attempt: Column | int, base_ms: int = 500, most_ms: int = 30_000) -> Column:
    """The delay before a retry, doubling from ``base_ms`` and never above ``most_ms``."""
    n = F.lit(attempt) if isinstance(attempt, int) else attempt
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.least(n, F.lit(20))), F.lit(float(most_ms))).cast("long")


def transient_status(status: Column | str) -> Column:
    """HTTP statuses worth a retry."""
    return col(status).isin(429, 500, 502, 503, 504)


def client_error(message: Column | str) -> Column:
    """Whether a search error is the request's: it names a collection that is not there."""
    m = F.lower(col(message))
    return m.contains("collection") & (m.contains("does not exist") | m.contains("not found"))
