"""Embedding through a provider port: inputs checked, packed under token and item limits, retried, put back in order."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.packing import Tokens

#: A provider embeds one batch of texts and may raise ``Transient`` for errors worth a retry.
Provider = Callable[[list[str]], list[list[float]]]


class Transient(Exception):
    """A provider's error that may pass: a timeout, a rate limit, a server error."""


def batches(counts: list[int], max_tokens: int, max_items: int) -> list[range]:
    """Consecutive ranges under both limits; an input over the token limit, or without tokens, is an error."""
    out: list[range] = []
    first = tokens = 0
    for i, n in enumerate(counts):
        if not 0 < n <= max_tokens:
            raise ValueError(f"embedding input {i} has {n} tokens; 1 to {max_tokens} are possible")
        if i > first and (tokens + n > max_tokens or i - first == max_items):
            out.append(range(first, i))
            first, tokens = i, 0
        tokens += n
    return [*out, range(first, len(counts))] if counts else out


def call(provider: Provider, texts: list[str], retries: int = 3, base_s: float = 0.5, most_s: float = 30.0, sleep=time.sleep) -> list[list[float]]:
    """One batch through the provider; transient errors are retried after doubling delays."""
    for attempt in range(retries + 1):
        try:
            got = provider(texts)
            if len(got) != len(texts):
                raise ValueError(f"the provider returned {len(got)} vectors for {len(texts)} texts")
            return got
        except Transient:
            if attempt == retries:
                raise
            sleep(min(most_s, base_s * 2 ** min(attempt, 20)))
    raise AssertionError("unreachable")


def embedded(rows: DataFrame, provider: Provider, dim: int, text: str = "text", tokens: Tokens | None = None, max_tokens: int = 8192, max_items: int = 32, retries: int = 3) -> DataFrame:
    """Adds ``dense`` to rows with texts; a vector of another size than ``dim`` is an error."""
    counter = tokens or Tokens()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "dense array<float>"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(text).to_pylist()
            vectors: list[list[float]] = []
            for r in batches([counter.count(t or "") for t in texts], max_tokens, max_items):
                vectors += call(provider, [texts[i] for i in r], retries)
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"the provider's vectors do not have {dim} components")
            column = pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "dense"])

    return rows.mapInArrow(run, schema)
