"""Settings: defaults, then a TOML file, then the environment; checked once."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """All settings of the engine.  Names of the environment are ``TESSERA_`` and the field in capitals."""

    collection: str = "demo"
    chunk_tokens: int = 600
    chunk_overlap: float = 0.15
    chunk_strategy: str = ""
    heading_detection: str = "on"
    dense_top_k: int = 20
    sparse_top_k: int = 20
    fts_top_k: int = 10
    rrf_k: int = 60
    bm25_avgdl: float = 300.0
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_query_b: float = 0.3
    context_tokens: int = 8000
    context_chunks: int = 50
    embedding_model: str = "text-embedding-3-small"
    embedding_batch_tokens: int = 8192
    embedding_batch_items: int = 32
    embedding_input_tokens: int = 8192
    embedding_retries: int = 3
    history_messages: int = 20
    rate_global: float = 1000.0
    burst_global: float = 200.0
    rate_tenant: float = 100.0
    burst_tenant: float = 50.0
    run_ttl_seconds: int = 86_400
    run_limit: int = 10_000
    agent_max_steps: int = 20
    ingest_roots: tuple[str, ...] = ()

    def checked(self) -> Settings:
        """Itself, or an error that names the first setting out of range."""
        for name in ("chunk_tokens", "dense_top_k", "sparse_top_k", "fts_top_k", "rrf_k", "context_tokens", "context_chunks", "embedding_batch_tokens", "embedding_batch_items", "history_messages", "run_limit", "agent_max_steps"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be greater than zero")
        if not 0 <= self.chunk_overlap < 1:
            raise ValueError("chunk_overlap must be in [0, 1)")
        if self.bm25_avgdl <= 0 or self.bm25_k1 < 0:
            raise ValueError("bm25_avgdl must be positive and bm25_k1 not negative")
        for name in ("bm25_b", "bm25_query_b"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in [0, 1]")
        return self


def _as(kind: type, value: object, name: str):
    try:
        if kind is tuple:
            return tuple(value.split(os.pathsep)) if isinstance(value, str) else tuple(value)
        return kind(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name} has an unreadable value: {value!r}") from e


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Settings from an optional TOML file (top level or a ``[tessera]`` table) under the environment."""
    found: dict[str, object] = {}
    if path:
        with open(path, "rb") as f:
            data = tomllib.load(f)
        found |= data.get("tessera", data)
    base = Settings()
    names = {f.name: type(getattr(base, f.name)) for f in fields(Settings)}
    if unknown := sorted(k for k in found if k not in names and not isinstance(found[k], dict)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    env = os.environ if env is None else env
    for name in names:
        if (value := env.get(f"TESSERA_{name.upper()}")) is not None:
            found[name] = value
    return replace(base, **{n: _as(k, found[n], n) for n, k in names.items() if n in found}).checked()
