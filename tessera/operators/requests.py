"""Small request rules: named values, credentials from headers, run dispositions and responses, readiness, signing keys."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packing import STRATEGIES
from ..functions.text import col
from .access import ROLES

#: Fixed values by kind, each with the spellings that stand for it; message roles count in exact case only.
NAMES = {
    "message_role": {"user": "user", "assistant": "assistant", "system": "system"},
    "role": {r: r for r in ROLES},
    "embedder": {"openai": "openai", "mock": "mock"},
    "auth_mode": {"none": "none", "api-key": "api-key", "oidc": "oidc"},
    "llm_provider": {"openai-compatible": "openai-compatible", "openai": "openai-compatible", "anthropic": "anthropic"},
    "strategy": {s: s for s in STRATEGIES},
}
EXACT = {"message_role"}


def parsed_name(kind: str, value: Column | str) -> Column:
    """(value, error) for a named value; ``error`` tells what is not known, null counts as unknown too."""
    table = F.create_map(*(F.lit(x) for pair in NAMES[kind].items() for x in pair))
    raw = col(value)
    found = F.element_at(table, raw if kind in EXACT else F.lower(raw))
    error = F.when(found.isNull(), F.concat(F.lit(f"unknown {kind.replace('_', ' ')}: "), F.coalesce(raw, F.lit("null"))))
    return F.struct(found.alias("value"), error.alias("error"))


def header_token(authorization: Column | str, api_key: Column | str) -> Column:
    """The credential of a request: a bearer token if there is one, else the key header; null without both."""
    bearer = F.when(F.startswith(col(authorization), F.lit("Bearer ")), F.trim(F.substring(col(authorization), 8, 1 << 30)))
    return F.coalesce(bearer, F.trim(col(api_key)))


def owned_accounts(asked: DataFrame, accounts: DataFrame) -> DataFrame:
    """The rows of ``asked(service_account_id, tenant)`` whose account belongs to their tenant."""
    return asked.join(accounts.select(F.col("id").alias("service_account_id"), "tenant"), ["service_account_id", "tenant"], "left_semi")


def inspect_disposition(owner: Column | str, tenant: Column | str, awaiting: Column | str) -> Column:
    """What a tenant's look at a run means for its eviction."""
    return F.when(~col(owner).eqNullSafe(col(tenant)), "not_owned").when(col(awaiting), "protect_run").otherwise("unprotected")


#: How states and kinds are written in responses.
WRITTEN = {
    "state": {"Running": "running", "AwaitingApproval": "awaiting_approval", "Completed": "completed", "Failed": "failed"},
    "step_status": {"Completed": "completed", "Paused": "paused", "Failed": "failed"},
    "query_type": {"Structured": "structured", "Unstructured": "unstructured", "Mixed": "mixed"},
    "route_path": {"SinglePassRag": "single_pass_rag", "AgenticSearch": "agentic_search"},
    "query_class": {"SimpleFact": "simple_fact", "AmbiguityDisambiguation": "ambiguity_disambiguation", "ExploratorySearch": "exploratory_search", "Procedural": "procedural", "MultiHopResearch": "multi_hop_research"},
    "retrieval_profile": {"SimpleHybrid": "simple_hybrid", "LexicalFirst": "lexical_first", "BroadThenExpand": "broad_then_expand"},
}
RESPONSE = ("run_id", "answer", "summary", "steps", "search_results")
CHECKPOINT = ("after_task", "summary", "checkpoint_id", "timeout_seconds", "on_timeout")
ROUTE = ("ambiguity", "needs_multi_hop", "needs_high_evidence", "time_sensitive", "normalized_filters", "reasons")


def written(kind: str, value: Column | str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in WRITTEN[kind].items() for x in pair)), col(value))


def run_responses(runs: DataFrame) -> DataFrame:
    """Run results as responses: states and kinds as they are written, and only the fields that leave the server."""
    have = set(runs.columns)
    out = [F.col(c) for c in RESPONSE if c in have] + [written("state", "state").alias("state")]
    if "query_type" in have:
        out.append(written("query_type", "query_type").alias("query_type"))
    if "route_decision" in have:
        d = F.col("route_decision")
        inside = runs.schema["route_decision"].dataType.names
        fields = [written("route_path", d["selected_path"]).alias("selected_path"), written("query_class", d["query_class"]).alias("query_class"), written("retrieval_profile", d["retrieval_profile"]).alias("retrieval_profile")]
        out.append(F.when(d.isNotNull(), F.struct(*fields, *(d[c].alias(c) for c in ROUTE if c in inside))).alias("route_decision"))
    if "pending_checkpoint" in have:
        d = F.col("pending_checkpoint")
        out.append(F.when(d.isNotNull(), F.struct(*(d[c].alias(c) for c in CHECKPOINT if c in runs.schema["pending_checkpoint"].dataType.names))).alias("pending_checkpoint"))
    return runs.select(*out)


def step_responses(steps: DataFrame) -> DataFrame:
    """Step records as responses: task, start (RFC 3339, in UTC), duration and written status."""
    start = F.date_format(F.to_utc_timestamp("started_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return steps.select("run_id", "task_id", start.alias("started_at"), "elapsed_ms", written("step_status", "status").alias("status"))


def run_error_status(message: Column | str) -> Column:
    """The HTTP status of a failed change of a run."""
    m = col(message)
    return F.when(m.contains("unknown run") | m.contains("no metadata for run"), 404).when(m.contains("AwaitingApproval") | m.contains("cannot resume"), 400).otherwise(500)


def readiness(checks: dict[str, Callable[[], object]], seconds: float = 5.0) -> dict:
    """Each backend's check, run side by side: ``ok``, ``<name> unavailable`` or a timeout; ready if all are ok."""
    from concurrent.futures import ThreadPoolExecutor, TimeoutError

    pool = ThreadPoolExecutor(max(1, len(checks)))
    begun, running = time.monotonic(), {name: pool.submit(check) for name, check in checks.items()}
    told = {}
    for name, job in running.items():
        try:
            job.result(max(0.0, seconds - (time.monotonic() - begun)))
            told[name] = "ok"
        except TimeoutError:
            told[name] = f"timeout after {seconds:g}s"
        except Exception:  # noqa: BLE001  whatever a backend raises, it is not ready
            told[name] = f"{name} unavailable"
    pool.shutdown(wait=False, cancel_futures=True)
    return {"ready": all(v == "ok" for v in told.values()), "checks": told}


class KeyCache:
    """Signing keys of token issuers by issuer and key id, fetched through a port: an issuer's for a key of its that is
    not there, and anew after the time to live.  A key of one issuer never stands for another's."""

    def __init__(self, fetch: Callable[[str], dict[str, object]], ttl_s: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.fetch, self.ttl_s, self.clock = fetch, ttl_s, clock
        self.keys: dict[str, tuple[float, dict[str, object]]] = {}

    def key(self, kid: str, issuer: str) -> object:
        at, known = self.keys.get(issuer, (0.0, {}))
        if kid not in known or self.clock() - at >= self.ttl_s:
            known = dict(self.fetch(issuer))
            self.keys[issuer] = self.clock(), known
        if kid not in known:
            raise KeyError(f"no signing key {kid!r} of {issuer!r}")
        return known[kid]
