"""Access rules over request logs: capabilities, route policies, API keys, token buckets, run registry."""

from __future__ import annotations

import hashlib
import hmac
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col

#: Fixed order of capabilities, and how many of them each role has beside what is listed.
CAPABILITIES = ("health.read", "collections.read", "search.read", "chat.use", "agents.operate", "ingest.write", "auth.keys.manage", "platform.admin")
READ = CAPABILITIES[:4]
ROLES = {"viewer": READ, "editor": (*READ, "ingest.write"), "agent_operator": CAPABILITIES[:6], "admin": CAPABILITIES[:7], "platform_operator": CAPABILITIES}
#: Fixed policy: method, path pattern, capability; the first pattern that fits decides.
POLICIES = (
    ("GET", "/agents", "agents.operate"), ("GET", "/runs", "agents.operate"), ("POST", "/ingest(/upload)?", "ingest.write"), ("POST", "/search/(dense|sparse|hybrid)", "search.read"),
    ("POST", "/chat", "chat.use"), ("POST", "/auth/(service-accounts|api-keys)", "auth.keys.manage"), ("GET", "/auth/api-keys", "auth.keys.manage"), ("GET", "/agents/(?!.*/execute$).*", "agents.operate"),
    ("POST", "/agents/.*/execute", "agents.operate"), ("GET", "/runs/[^/]+", "agents.operate"), ("POST", "/runs/.*/(approve|reject)", "agents.operate"), ("GET", "/collections/.*/stats", "collections.read"),
    ("DELETE", "/auth/api-keys/.*", "auth.keys.manage"),
)
KNOWN_PATHS = r"^(/agents(/.*)?|/runs(/.*)?|/ingest(/upload)?|/search/(dense|sparse|hybrid)|/chat|/auth/(service-accounts|api-keys)|/auth/api-keys/.*|/collections/.*/stats)$"


def role_capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, c) for r, cs in ROLES.items() for c in cs], "role string, capability string")


def required_capability(method: Column | str, path: Column | str) -> Column:
    """The capability a request needs; null where no policy fits.  HEAD counts as GET."""
    m = F.when(col(method) == "HEAD", "GET").otherwise(col(method))
    out = F.lit(None).cast("string")
    for verb, pattern, capability in reversed(POLICIES):
        out = F.when((m == verb) & col(path).rlike(f"^{pattern}$"), F.lit(capability)).otherwise(out)
    return out


def authorise(requests: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Adds ``capability`` and ``decision``: allowed, forbidden, method_not_allowed (passes on) or unmapped (refused)."""
    roles = role_capabilities(requests.sparkSession) if roles is None else roles
    r = requests.withColumn("capability", required_capability("method", "path"))
    granted = F.broadcast(roles.withColumn("granted", F.lit(True)))  # five roles, eight capabilities
    joined = r.join(granted, ["role", "capability"], "left")
    decision = (
        F.when(F.col("capability").isNull() & F.col("path").rlike(KNOWN_PATHS), "method_not_allowed").when(F.col("capability").isNull(), "unmapped").when(F.col("granted"), "allowed").otherwise("forbidden")
    )
    return joined.select(*requests.columns, "capability", decision.alias("decision"))


KEY_MARK = "tk"


def generate_key(mark: str = KEY_MARK) -> tuple[str, str, str]:
    """A new API key: the token to hand out, its public prefix and the hash to store."""
    prefix, secret = secrets.token_hex(6), secrets.token_hex(24)
    return f"{mark}_{prefix}_{secret}", prefix, hashlib.sha256(secret.encode()).hexdigest()


def verify_secret(secret: str, stored: str) -> bool:
    return hmac.compare_digest(hashlib.sha256(secret.encode()).hexdigest(), stored)


def parsed_key(token: Column | str, mark: str = KEY_MARK) -> Column:
    """(prefix, secret) of a token; null if it is not one."""
    parts = F.split(col(token), "_", 3)
    ok = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == mark) & (F.get(parts, F.lit(1)) != "") & (F.get(parts, F.lit(2)) != "")
    return F.when(ok, F.struct(F.get(parts, F.lit(1)).alias("prefix"), F.get(parts, F.lit(2)).alias("secret")))


def authenticate(requests: DataFrame, keys: DataFrame, accounts: DataFrame, now: Column | None = None) -> DataFrame:
    """Adds principal and ``error`` to ``requests(token, tenant)``: the first check that fails names the error."""
    now = F.current_timestamp() if now is None else now
    r = requests.withColumn("k", parsed_key("token"))
    k = keys.select(F.col("key_prefix").alias("prefix"), "service_account_id", "key_hash", "expires_at", "revoked_at")
    a = accounts.select(F.col("id").alias("service_account_id"), F.col("tenant").alias("account_tenant"), "role", "disabled_at")
    j = r.withColumn("prefix", F.col("k.prefix")).join(k, "prefix", "left").join(a, "service_account_id", "left")
    error = (
        F.when(F.col("k").isNull(), "malformed key")
        .when(F.col("key_hash").isNull(), "unknown key")
        .when(F.sha2(F.col("k.secret"), 256) != F.col("key_hash"), "wrong secret")
        .when(F.col("revoked_at").isNotNull(), "revoked")
        .when(F.col("expires_at") <= now, "expired")
        .when(F.col("disabled_at").isNotNull(), "disabled")
        .when(~F.coalesce(F.lower("role").isin(*ROLES), F.lit(False)), "unknown role")
        .when(F.col("account_tenant") != F.col("tenant"), "wrong tenant")
    )
    return j.select(*requests.columns, F.when(error.isNull(), F.col("service_account_id")).alias("principal"), F.when(error.isNull(), F.lower("role")).alias("role"), error.alias("error"))


def listed_keys(keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """Keys with their account's tenant and role, newest first."""
    a = accounts.select(F.col("id").alias("service_account_id"), "tenant", "role", F.col("name").alias("account"))
    return keys.join(a, "service_account_id").orderBy(F.desc("created_at"), "id")


def revoked(keys: DataFrame, accounts: DataFrame, key_id: str, tenant: str, now: Column) -> DataFrame:
    """The keys with one revoked, if it is not yet and belongs to an account of the tenant."""
    own = accounts.where(F.col("tenant") == tenant).select(F.col("id").alias("service_account_id")).withColumn("own", F.lit(True))
    hit = (F.col("id") == key_id) & F.col("revoked_at").isNull() & F.col("own")
    return keys.join(own, "service_account_id", "left").withColumn("revoked_at", F.when(hit, now).otherwise(F.col("revoked_at"))).select(*keys.columns)


def oidc_role(principals: DataFrame, known: DataFrame) -> DataFrame:
    """The role of each (tenant, issuer, subject); viewer where none is stored."""
    k = known.where("disabled_at is null").select("tenant", "issuer", "subject", "role")
    return principals.join(k, ["tenant", "issuer", "subject"], "left").withColumn("role", F.coalesce("role", F.lit("viewer")))


def route_class(path: Column | str) -> Column:
    """The part of the rate-limit key that tells kinds of requests apart."""
    first = F.regexp_extract(col(path), "^/([^/]+)", 1)
    return F.when(first == "", "root").otherwise(first)


def refilled_parts(requests: DataFrame, rate: float, burst: float, *key: str, at: str, order: str, slot_s: float = 60.0) -> DataFrame:
    """Adds ``bucket_part``: numbers of the parts of a key's history between gaps that refill the bucket.

    Gaps are found in slots of time, so that a busy key is not sorted in one task: inside a slot by its own rows, before
    its first row by the last one of the slots before, of which there is one row a slot.
    """
    slots = F.floor(F.col(at) / slot_s)
    rows = requests.withColumn("bucket_slot", slots)
    ends = rows.groupBy(*key, "bucket_slot").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    by = Window.partitionBy(*key).orderBy("bucket_slot")
    ends = ends.withColumn("before_at", F.lag("last_at").over(by))
    w = Window.partitionBy(*key, "bucket_slot").orderBy(at, order)
    inner = F.col(at) - F.lag(at).over(w)
    rows = rows.withColumn("begins", F.coalesce((inner * rate >= burst).cast("int"), F.lit(0))).withColumn("bucket_part", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counts = rows.groupBy(*key, "bucket_slot").agg(F.sum("begins").alias("inner"))
    slot = [*key, "bucket_slot"]
    told = ends.alias("a").join(counts.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in slot]).select(*(F.col(f"a.{c}").alias(f"of_{c}") for c in slot), "first_at", "before_at", "inner")
    fresh = (F.col("before_at").isNull() | ((F.col("first_at") - F.col("before_at")) * rate >= burst)).cast("int")
    over = Window.partitionBy(*(f"of_{c}" for c in key)).orderBy("of_bucket_slot")
    begun = F.sum(fresh).over(over.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("inner").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = told.select(*(f"of_{c}" for c in slot), begun.alias("begun"))
    met = rows.join(told, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in slot])
    return met.withColumn("bucket_part", F.col("bucket_part") + F.col("begun")).select(*requests.columns, "bucket_part")


def token_bucket(requests: DataFrame, rate: float, burst: float, *key: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Replay of a token bucket for each key: adds ``allowed``.

    A key's requests are folded in time order.  The fold is sequential by nature, so a key's history is cut at gaps
    long enough to refill the bucket: each part starts full and is folded on its own, wherever it is.  Parts are sorted
    in their partitions and streamed past one state, so a long part is never held.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp")).cast("double") / 1e6
    rows = refilled_parts(requests.withColumn("bucket_at", t), rate, burst, *key, at="bucket_at", order=order)
    dealt = rows.repartition(*key, "bucket_part").sortWithinPartitions(*key, "bucket_part", "bucket_at", order)
    names, schema = requests.columns, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema), "allowed boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, full, last = None, burst, 0.0
        for batch in batches:
            out = []
            for part in zip(*(batch.column(c).to_pylist() for c in (*key, "bucket_part", "bucket_at")), strict=True):
                if part[:-1] != at:
                    at, full, last = part[:-1], float(burst), part[-1]
                full = min(float(burst), full + (part[-1] - last) * rate)
                last = part[-1]
                out.append(full >= 1)
                full -= out[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.bool_())], names=[*names, "allowed"])

    return dealt.mapInArrow(run, schema)


def pruned_runs(runs: DataFrame, now: Column, ttl_s: int = 24 * 3600, most: int = 10_000) -> DataFrame:
    """Runs that stay: none older than the time to live, the newest ``most``; runs awaiting approval never expire by
    age and are the last to be evicted."""
    fresh = runs.where(F.col("awaiting_approval") | (F.col("inserted_at") > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_s))))
    return fresh.orderBy(F.desc("awaiting_approval"), F.desc("inserted_at"), F.desc("run_id")).limit(most)
