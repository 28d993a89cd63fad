"""Queries over request rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import requests as Q
from .registry import query, table

_GIVEN = ("user", "User", "ASSISTANT", "editor", "Admin", "MOCK", "Api-Key", "OpenAI", "anthropic", "Markdown", "nothing", "system")
_KINDS = ("message_role", "role", "embedder", "auth_mode", "llm_provider", "strategy")


@query("""
WITH g AS (SELECT event_id, list_extract(['user', 'User', 'ASSISTANT', 'editor', 'Admin', 'MOCK', 'Api-Key', 'OpenAI', 'anthropic', 'Markdown', 'nothing', 'system'], CAST(event_id % 12 + 1 AS INTEGER)) AS x FROM events),
k AS (SELECT event_id, x, unnest(['message_role', 'role', 'embedder', 'auth_mode', 'llm_provider', 'strategy']) AS kind FROM g),
v AS (SELECT *, CASE kind WHEN 'message_role' THEN CASE WHEN x IN ('user', 'assistant', 'system') THEN x END
  WHEN 'role' THEN CASE WHEN lower(x) IN ('viewer', 'editor', 'agent_operator', 'admin', 'platform_operator') THEN lower(x) END
  WHEN 'embedder' THEN CASE WHEN lower(x) IN ('openai', 'mock') THEN lower(x) END WHEN 'auth_mode' THEN CASE WHEN lower(x) IN ('none', 'api-key', 'oidc') THEN lower(x) END
  WHEN 'llm_provider' THEN CASE lower(x) WHEN 'openai' THEN 'openai-compatible' WHEN 'openai-compatible' THEN 'openai-compatible' WHEN 'anthropic' THEN 'anthropic' END
  ELSE CASE WHEN lower(x) IN ('chars', 'tokens', 'sentences', 'paragraphs', 'pages', 'page_tokens', 'markdown', 'recursive_chars', 'semantic') THEN lower(x) END END AS value FROM k)
SELECT event_id, kind, coalesce(value, '') AS value, CASE WHEN value IS NULL THEN 'unknown ' || replace(kind, '_', ' ') || ': ' || x ELSE '' END AS error FROM v""")
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given value read as every kind of named value."""
    given = F.get(F.array(*map(F.lit, _GIVEN)), (F.col("event_id") % 12).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", given.alias("x"))
    read = F.array(*(F.struct(F.lit(k).alias("kind"), Q.parsed_name(k, "x").alias("p")) for k in _KINDS))
    return rows.select("event_id", F.explode(read).alias("r")).select("event_id", "r.kind", F.coalesce("r.p.value", F.lit("")).alias("value"), F.coalesce("r.p.error", F.lit("")).alias("error"))


@query("""
WITH h AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'Bearer  b' || event_id || ' ' WHEN 1 THEN 'Basic x' WHEN 2 THEN 'bearer y' END AS a, CASE WHEN event_id % 3 = 0 THEN ' k' || event_id END AS k FROM events)
SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN 'b' || event_id ELSE trim(k) END, '') AS token FROM h""")
def header_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = e.cast("string")
    authorization = F.when(e % 4 == 0, F.concat(F.lit("Bearer  b"), text, F.lit(" "))).when(e % 4 == 1, "Basic x").when(e % 4 == 2, "bearer y")
    key = F.when(e % 3 == 0, F.concat(F.lit(" k"), text))
    rows = table(spark, sf_dir, "events").select("event_id", authorization.alias("a"), key.alias("k"))
    return rows.select("event_id", F.coalesce(Q.header_token("a", "k"), F.lit("")).alias("token"))


@query("SELECT event_id, user_id AS service_account_id FROM events WHERE user_id % 3 = event_id % 3")
def owned_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for a service account by its own tenant."""
    log = table(spark, sf_dir, "events")
    asked = log.select("event_id", F.col("user_id").alias("service_account_id"), (F.col("event_id") % 3).alias("tenant"))
    accounts = log.select(F.col("user_id").alias("id"), (F.col("user_id") % 3).alias("tenant")).distinct()
    return Q.owned_accounts(asked, accounts).select("event_id", "service_account_id")


@query("SELECT event_id AS run_id, CASE WHEN user_id % 2 <> event_id % 2 THEN 'not_owned' WHEN event_id % 7 = 0 THEN 'protect_run' ELSE 'unprotected' END AS disposition FROM events")
def run_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("run_id"), Q.inspect_disposition(F.col("user_id") % 2, F.col("event_id") % 2, F.col("event_id") % 7 == 0).alias("disposition"))


@query("""
SELECT event_id AS run_id, event_type AS answer, list_extract(['running', 'awaiting_approval', 'completed', 'failed'], CAST(event_id % 4 + 1 AS INTEGER)) AS state, list_extract(['structured', 'unstructured', 'mixed'], CAST(event_id % 3 + 1 AS INTEGER)) AS query_type,
  CASE WHEN event_id % 2 = 0 THEN list_extract(['simple_fact', 'ambiguity_disambiguation', 'exploratory_search', 'procedural', 'multi_hop_research'], CAST(event_id % 5 + 1 AS INTEGER)) ELSE '' END AS query_class,
  CASE WHEN event_id % 2 = 0 THEN list_extract(['simple_hybrid', 'lexical_first', 'broad_then_expand'], CAST(event_id % 3 + 1 AS INTEGER)) ELSE '' END AS profile, event_id % 4 = 1 AS pending FROM events""")
def run_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run results as they are answered."""
    e = F.col("event_id")
    pick = lambda kind, n: F.get(F.array(*map(F.lit, Q.WRITTEN[kind])), (e % n).cast("int"))
    route = F.struct(F.lit("AgenticSearch").alias("selected_path"), pick("query_class", 5).alias("query_class"), pick("retrieval_profile", 3).alias("retrieval_profile"), F.lit(True).alias("ambiguity"), F.lit("x").alias("internal"))
    point = F.struct(F.lit("t").alias("after_task"), F.lit("c").alias("checkpoint_id"), F.lit("x").alias("internal"))
    runs = table(spark, sf_dir, "events").select(e.alias("run_id"), F.col("event_type").alias("answer"), pick("state", 4).alias("state"), pick("query_type", 3).alias("query_type"), F.when(e % 2 == 0, route).alias("route_decision"), F.when(e % 4 == 1, point).alias("pending_checkpoint"), F.lit("x").alias("internal"))
    told = Q.run_responses(runs)
    return told.select("run_id", "answer", "state", "query_type", F.coalesce("route_decision.query_class", F.lit("")).alias("query_class"), F.coalesce("route_decision.retrieval_profile", F.lit("")).alias("profile"), F.col("pending_checkpoint").isNotNull().alias("pending"))
