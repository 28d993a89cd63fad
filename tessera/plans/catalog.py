"""All queries of the retrieval engine with their SQL twins."""

from __future__ import annotations

from . import admin, corpus, requests, search  # noqa: F401  registering their queries
from .registry import ORACLES, QUERIES

FLAGSHIP = "sparse_topk"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
