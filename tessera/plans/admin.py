"""Queries over tables kept up to date, conversations, access rules, layouts, sidecars and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..operators import access, chat, ingest, layout, stores
from ..operators import chunking as CH
from ..operators import index as I
from ..operators import retrieval as R
from ..sources import files
from ..streaming import events as ST
from .registry import corpus, query, table

NOW = "2024-06-01 00:00:00"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as they were stored a while ago."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return corpus(spark, sf_dir).select("tenant", F.col("document_id").alias("id"), "collection", T.checksum("text").alias("checksum"), F.length("text").cast("long").alias("token_count"), at.alias("created_at"), at.alias("updated_at"))


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as they come again: every fifth under a new id, every fourth with a changed text."""
    rows = corpus(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("new-"), "document_id")).otherwise(F.col("document_id"))
    return rows.select("doc_id", "text", "tenant", name.alias("id"), F.concat("collection", F.lit("-new")).alias("collection"), T.checksum("text").alias("checksum"), F.length("text").cast("long").alias("token_count"))


_SUM = "CASE WHEN doc_id % 4 = 0 THEN sha256(text || '!') ELSE sha256(text) END"


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN source ELSE source || '-new' END AS collection, CASE WHEN doc_id % 5 = 0 THEN sha256(text) ELSE {_SUM} END AS checksum,
  '2024-01-01' AS created, CASE WHEN doc_id % 5 = 0 THEN '2024-01-01' ELSE '2024-06-01' END AS updated FROM documents
UNION ALL SELECT 'new-' || doc_id, source || '-new', {_SUM}, '2024-06-01', '2024-06-01' FROM documents WHERE doc_id % 5 = 0""")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stores.upsert(_stored(spark, sf_dir), _incoming(spark, sf_dir), ["tenant", "id"], F.lit(NOW).cast("timestamp"))
    return rows.select("id", "collection", "checksum", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'new-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id, doc_id % 5 <> 0 AND doc_id % 4 <> 0 AS skip FROM documents")
def unchanged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _incoming(spark, sf_dir).withColumnRenamed("id", "document_id")
    return stores.unchanged(new, _stored(spark, sf_dir)).select(F.col("document_id").alias("id"), "skip")


@query("""
WITH t AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN list_filter(w, lambda x: length(x) > 4) ELSE w END AS w FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(w[i * 20 + 1 : i * 20 + 20], ' ') AS text
FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 20.0) AS INTEGER))) AS i FROM s)""")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document loses its words of up to four letters; its chunks are replaced, and those too many go."""
    rows = corpus(spark, sf_dir)
    cut = lambda r: CH.token_chunks(r, 20, 0.0, "tenant", "document_id").drop("n_tokens")
    touched = rows.select("tenant", "document_id", (F.col("doc_id") % 5 == 0).alias("changed")).where("changed").drop("changed")
    shorter = rows.withColumn("text", F.array_join(F.filter(T.words("text"), lambda w: F.length(w) > 4), " "))
    new = cut(shorter).join(touched, ["tenant", "document_id"], "left_semi")
    out = stores.replace_chunks(cut(rows), new, touched, rows.select("tenant", F.col("document_id").alias("id")))
    return out.select(F.col("document_id").cast("long").alias("doc_id"), "chunk_index", "text")


@query("""
WITH t AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents WHERE doc_id % 7 <> 0)
SELECT 'document' AS kind, doc_id, CAST(-1 AS INTEGER) AS chunk_index, '' AS digest FROM t
UNION ALL SELECT 'chunk', doc_id, CAST(i AS INTEGER), md5(array_to_string(w[i * 100 + 1 : i * 100 + 100], ' ')) FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 100.0) AS INTEGER))) AS i FROM t)""")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents and chunks when every seventh document is deleted."""
    rows = corpus(spark, sf_dir)
    docs = rows.select("tenant", F.col("document_id").alias("id"), "doc_id")
    gone = docs.withColumn("gone", F.col("doc_id") % 7 == 0).where("gone")
    left, chunks = stores.delete_document(docs, CH.token_chunks(rows, 100, 0.0, "tenant", "document_id"), gone)
    return left.select(F.lit("document").alias("kind"), "doc_id", F.lit(-1).alias("chunk_index"), F.lit("").alias("digest")).union(chunks.select(F.lit("chunk"), F.col("document_id").cast("long"), "chunk_index", F.md5("text")))


@query("""
WITH b AS (SELECT source AS collection, -1 AS d, -n_chars AS t FROM documents UNION ALL SELECT CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN 'moved' ELSE source END, 1, n_chars FROM documents)
SELECT collection, CAST(sum(d) AS BIGINT) AS docs, CAST(sum(t) AS BIGINT) AS tokens FROM b WHERE collection IS NOT NULL GROUP BY collection HAVING sum(d) <> 0 OR sum(t) <> 0""")
def stats_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed changes when documents move to another collection or lose theirs."""
    d = table(spark, sf_dir, "documents")
    before = d.select(F.lit("default").alias("tenant"), F.col("source").alias("stats_collection"), F.col("n_chars").alias("stats_token_count"))
    to = F.when(F.col("doc_id") % 10 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 6 == 0, "moved").otherwise(F.col("source"))
    after = d.select(F.lit("default").alias("tenant"), to.alias("stats_collection"), F.col("n_chars").alias("stats_token_count"))
    return stores.stats_deltas(before, after).select("collection", "docs", "tokens")


@query("SELECT DISTINCT source AS collection FROM documents")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.collections(corpus(spark, sf_dir))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


_LATEST = "latest AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS age FROM conversations)"


@query(f"WITH {_LATEST} SELECT conv_id, turn, role FROM latest WHERE age <= 4 AND role <> 'system'")
def model_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of each conversation, system messages counted and then dropped."""
    m = _messages(spark, sf_dir).withColumn("at", F.struct("turn"))
    return chat.model_history(m, 4, conversation="conv_id", order=("turn", "role", "content")).select("conv_id", "turn", "role")


@query("""
WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text FROM conversations),
c AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS ch FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS isl FROM c)
SELECT conv_id, CAST(isl AS BIGINT) AS turn, role, md5(string_agg(text, chr(10) ORDER BY turn, role, text)) AS content FROM i GROUP BY conv_id, isl, role""")
def coalesced_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive messages of one role as one; system messages count as the user's here, so that there are some."""
    m = _messages(spark, sf_dir).withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    placed = m.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "content")))
    return chat.coalesced(placed, "conv_id").withColumn("content", F.md5("content"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE conv_id % 3 <> 1 GROUP BY conv_id")
def owned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).select(F.lit("a").alias("tenant"), F.col("conv_id").alias("conversation_id"), "content")
    c = _messages(spark, sf_dir).select(F.when(F.col("conv_id") % 3 == 1, "b").otherwise("a").alias("tenant"), F.col("conv_id").alias("id")).distinct()
    return chat.owned(m, c).groupBy(F.col("conversation_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN CAST(doc_id AS VARCHAR) ELSE CAST(-doc_id AS VARCHAR) END AS conversation_id,
  CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN NULL ELSE 'c' END WHEN doc_id % 4 = 1 THEN source WHEN doc_id % 8 = 0 THEN NULL ELSE 'c' END AS resolved_collection,
  CASE WHEN doc_id % 4 >= 2 THEN 'conversation not found' WHEN doc_id % 4 = 1 AND source <> 'c' THEN 'collection does not match the conversation' WHEN doc_id % 8 = 0 THEN 'collection is required' END AS error, doc_id % 4 = 0 AS is_new
FROM documents""")
def resolved_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    conv = F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 4 == 1, F.col("doc_id").cast("string")).otherwise((-F.col("doc_id")).cast("string"))
    requests = d.select("doc_id", F.lit("t").alias("tenant"), conv.alias("conversation_id"), F.when(F.col("doc_id") % 8 == 0, " ").otherwise("c").alias("collection"))
    stored = d.select(F.lit("t").alias("tenant"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("collection"))
    return chat.resolved(requests, stored).select("doc_id", "conversation_id", "resolved_collection", "error", "is_new")


@query("""
WITH r(role, n) AS (VALUES ('viewer', 4), ('editor', 5), ('agent_operator', 6), ('admin', 7), ('platform_operator', 8)) SELECT role, CAST(n AS BIGINT) AS capabilities FROM r""")
def role_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.role_capabilities(spark).groupBy("role").agg(F.count(F.lit(1)).alias("capabilities"))


_PATHS = (("GET", "/agents"), ("POST", "/agents/x/execute"), ("HEAD", "/runs/7"), ("POST", "/ingest"), ("POST", "/chat"), ("GET", "/chat"), ("GET", "/nowhere"), ("DELETE", "/auth/api-keys/9"), ("GET", "/collections/c/stats"), ("PUT", "/runs/7"))
_ROLES = ("viewer", "editor", "agent_operator", "admin", "platform_operator")


@query("""
WITH e AS (SELECT event_id, event_id % 10 AS p, user_id % 5 AS r FROM events)
SELECT event_id, CASE p WHEN 0 THEN 'agents.operate' WHEN 1 THEN 'agents.operate' WHEN 2 THEN 'agents.operate' WHEN 3 THEN 'ingest.write' WHEN 4 THEN 'chat.use' WHEN 7 THEN 'auth.keys.manage' WHEN 8 THEN 'collections.read' END AS capability,
  CASE WHEN p IN (5, 9) THEN 'method_not_allowed' WHEN p = 6 THEN 'unmapped' WHEN p IN (0, 1, 2) AND r < 2 THEN 'forbidden' WHEN p = 3 AND r < 1 THEN 'forbidden' WHEN p = 7 AND r < 3 THEN 'forbidden' ELSE 'allowed' END AS decision FROM e""")
def authorised_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(p).alias("path")) for m, p in _PATHS))
    log = table(spark, sf_dir, "events").select("event_id", F.get(made, (F.col("event_id") % 10).cast("int")).alias("x"), F.get(F.array(*map(F.lit, _ROLES)), (F.col("user_id") % 5).cast("int")).alias("role"))
    return access.authorise(log.select("event_id", "x.method", "x.path", "role")).select("event_id", "capability", "decision")


@query("""
SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'malformed key' WHEN 1 THEN 'unknown key' WHEN 2 THEN 'wrong secret' WHEN 3 THEN 'revoked' WHEN 4 THEN 'expired' WHEN 5 THEN 'disabled' WHEN 6 THEN 'unknown role' WHEN 7 THEN 'wrong tenant' END AS error,
  CASE WHEN event_id % 9 = 8 THEN 'editor' END AS role FROM events""")
def authenticated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp")
    case = F.col("event_id") % 9
    token = F.when(case == 0, "nonsense").when(case == 1, "tk_absent_s").otherwise(F.concat(F.lit("tk_p"), case.cast("string"), F.lit("_"), F.when(case == 2, "other").otherwise("secret")))
    requests = table(spark, sf_dir, "events").select("event_id", token.alias("token"), F.lit("t").alias("tenant"))
    ids = spark.range(2, 9).select(F.col("id").cast("string").alias("id"))
    keys = ids.select("id", F.col("id").alias("service_account_id"), F.concat(F.lit("p"), "id").alias("key_prefix"), F.sha2(F.lit("secret"), 256).alias("key_hash"), F.when(F.col("id") == "4", at("2024-01-01")).otherwise(at("2030-01-01")).alias("expires_at"), F.when(F.col("id") == "3", at("2024-01-01")).alias("revoked_at"))
    accounts = ids.select("id", F.when(F.col("id") == "7", "other").otherwise("t").alias("tenant"), F.when(F.col("id") == "6", "king").otherwise("Editor").alias("role"), F.when(F.col("id") == "5", at("2024-01-01")).alias("disabled_at"))
    return access.authenticate(requests, keys, accounts, at(NOW)).select("event_id", "error", "role")


@query("""
WITH l AS (SELECT user_id, event_type, list(event_id ORDER BY ts, event_id) AS ids, list(epoch_us(ts) / 1000000.0::DOUBLE ORDER BY ts, event_id) AS ats FROM events GROUP BY user_id, event_type),
f AS (SELECT user_id, event_type, ids, list_reduce(list_prepend({'k': 3.0::DOUBLE, 'l': NULL::DOUBLE, 'o': []::BOOLEAN[]}, list_transform(ats, lambda x: {'k': 0.0::DOUBLE, 'l': x, 'o': []::BOOLEAN[]})),
  lambda a, x: {'k': least(3.0::DOUBLE, a.k + coalesce(x.l - a.l, 0) * (1::DOUBLE / 60)) - CASE WHEN least(3.0::DOUBLE, a.k + coalesce(x.l - a.l, 0) * (1::DOUBLE / 60)) >= 1 THEN 1 ELSE 0 END, 'l': x.l,
    'o': list_append(a.o, least(3.0::DOUBLE, a.k + coalesce(x.l - a.l, 0) * (1::DOUBLE / 60)) >= 1)}).o AS o FROM l)
SELECT unnest(ids) AS event_id, user_id, event_type, unnest(o) AS allowed FROM f""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket of one request a minute with a burst of three, for each user and event type."""
    log = table(spark, sf_dir, "events")
    return access.token_bucket(log, 1 / 60, 3, "user_id", "event_type").select("event_id", "user_id", "event_type", "allowed")


@query("""
WITH r AS (SELECT event_id AS run_id, ts AS inserted_at, event_id % 50 = 0 AS awaiting FROM events), m AS (SELECT max(ts) AS now FROM events),
f AS (SELECT r.* FROM r, m WHERE awaiting OR inserted_at > now - INTERVAL 7 DAY), o AS (SELECT *, row_number() OVER (ORDER BY awaiting DESC, inserted_at DESC, run_id DESC) AS place FROM f)
SELECT run_id, awaiting AS awaiting_approval FROM o WHERE place <= 400""")
def pruned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events")
    now = log.agg(F.max("ts").alias("now")).first().now
    runs = log.select(F.col("event_id").alias("run_id"), F.col("ts").alias("inserted_at"), (F.col("event_id") % 50 == 0).alias("awaiting_approval"))
    return access.pruned_runs(runs, F.lit(now), 7 * 24 * 3600, 400).select("run_id", "awaiting_approval")


_SPANS = """
sp AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
spans AS (SELECT page_id, i, text, CASE (page_id + i) % 5 WHEN 0 THEN 24.0 WHEN 1 THEN 12.0 ELSE 10.0 END AS font_size, i % 3 = 0 AS is_bold FROM sp WHERE regexp_matches(text, '\\S'))
"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("i", F.col("i") + 1)
    case = (F.col("page_id") + F.col("i")) % 5
    size = F.when(case == 0, 24.0).when(case == 1, 12.0).otherwise(10.0)
    return rows.select("page_id", "i", "text", size.alias("font_size"), (F.col("i") % 3 == 0).alias("is_bold"), (150.0 * (F.col("i") % 2)).alias("x_position"), (-30.0 * F.floor(F.col("i") / 2)).alias("y_position"), (150.0 * (F.col("i") % 2) + 100).alias("x_end"))


_BODY = rf"""
{_SPANS}, b AS (SELECT page_id, CAST(round(font_size * 10) AS INTEGER) AS bucket, sum(len(regexp_extract_all(text, '\p{{L}}'))) AS n FROM spans GROUP BY page_id, bucket HAVING sum(len(regexp_extract_all(text, '\p{{L}}'))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, bucket) AS k, sum(n) OVER (PARTITION BY page_id) AS total FROM b),
body AS (SELECT page_id, CASE WHEN n >= total * 0.2 THEN bucket / 10 END AS body_size FROM r WHERE k = 1)
"""


@query(f"WITH {_BODY} SELECT page_id, CAST(body_size AS DOUBLE) AS body_size FROM body")
def layout_body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_sizes(_spans(spark, sf_dir))


@query(rf"""
WITH {_BODY}, l AS (SELECT s.page_id, s.i, s.text, s.is_bold, s.font_size / body_size AS q, length(s.text) AS n, len(regexp_extract_all(s.text, '\p{{L}}')) AS a FROM spans s JOIN body USING (page_id) WHERE body_size IS NOT NULL)
SELECT page_id, CAST(i AS INTEGER) AS i, CAST(CASE WHEN q >= 2 - 1e-6 THEN 1 WHEN q >= 1.6 - 1e-6 THEN 2 WHEN q >= 1.2 - 1e-6 THEN 3 WHEN is_bold AND q >= 1.1 - 1e-6 AND NOT regexp_matches(text, '[.?!]') THEN 3 END AS INTEGER) AS level FROM l
WHERE n BETWEEN 3 AND 180 AND a >= 3 AND a * 2 >= n AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 20 AND len(regexp_extract_all(text, '[.?!]')) < 3
  AND (q >= 1.2 - 1e-6 OR (is_bold AND q >= 1.1 - 1e-6 AND NOT regexp_matches(text, '[.?!]')))""")
def layout_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    sized = layout.usable_spans(spans).join(layout.body_sizes(spans).where("body_size is not null"), "page_id")
    return layout.classified(sized).where("level is not null").select("page_id", "i", "level")


@query(rf"""
WITH {_BODY},
m AS (SELECT *, row_number() OVER (PARTITION BY page_id, i // 2 ORDER BY i) AS k, len(regexp_extract_all(text, '\p{{L}}')) AS a FROM spans),
j AS (SELECT page_id, i // 2 AS g, max(CASE WHEN k = 1 THEN text END) AS t1, max(CASE WHEN k = 2 THEN text END) AS t2, sum(font_size * length(text)) / sum(length(text)) AS size, 2 * sum(CASE WHEN is_bold THEN a ELSE 0 END) > sum(a) AND sum(a) > 0 AS is_bold FROM m GROUP BY page_id, i // 2),
w AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY g) - 1 AS line, t1 || CASE WHEN t2 IS NULL THEN '' WHEN t1 LIKE '%-' THEN t2 ELSE ' ' || t2 END AS text, size, is_bold FROM j),
l AS (SELECT w.*, size / body_size AS q, length(text) AS n, len(regexp_extract_all(text, '\p{{L}}')) AS a FROM w JOIN body USING (page_id) WHERE body_size IS NOT NULL)
SELECT page_id, CAST(line AS INTEGER) AS line, CAST(CASE WHEN q >= 2 - 1e-6 THEN 1 WHEN q >= 1.6 - 1e-6 THEN 2 WHEN q >= 1.2 - 1e-6 THEN 3 ELSE 3 END AS INTEGER) AS level, text FROM l
WHERE n BETWEEN 3 AND 180 AND a >= 3 AND a * 2 >= n AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 20 AND len(regexp_extract_all(text, '[.?!]')) < 3
  AND (q >= 1.2 - 1e-6 OR (is_bold AND q >= 1.1 - 1e-6 AND NOT regexp_matches(text, '[.?!]')))""")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings among lines of up to two spans each."""
    return layout.headings(_spans(spark, sf_dir))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'unsupported schema_version' WHEN 2 THEN 'document.title must not be empty' WHEN 3 THEN 'tags must contain at least one entry' WHEN 4 THEN 'ingestion.chunking.overlap_ratio must be in [0, 1)' ELSE 'the sidecar is not readable' END AS errors FROM documents""")
def sidecar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("doc_id") % 6
    json = F.concat(
        F.lit('{"schema_version":'), F.when(case == 1, "2").otherwise("1"), F.lit(',"document":{"title":"'), F.when(case == 2, "").otherwise("t"), F.lit('","category":"c"},"source":{"url":"u","domain":"d","publisher":"p"},"language":"'), F.col("lang"),
        F.lit('","tags":'), F.when(case == 3, "[]").otherwise('["x"]'), F.lit(',"acl":{"allow_roles":["viewer"]},"security":{"classification":"public"},"provenance":{"retrieved_at":"2024","retrieved_by":"me"},"ingestion":{"chunking":{"overlap_ratio":'),
        F.when(case == 4, "1.5").otherwise("0.2"), F.when(case == 5, "").otherwise("}}}"),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", json.alias("json"))
    return files.parsed_sidecars(rows).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'text' WHEN 3 THEN 'markdown' END AS file_type FROM documents")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, (".PDF", "md", "txt", "..Markdown", "png")))
    return table(spark, sf_dir, "documents").select("doc_id", files.file_type(F.get(names, (F.col("doc_id") % 5).cast("int"))).alias("file_type"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'ocr' ELSE 'native' END AS decision, CASE doc_id % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'deu' ELSE 'deu+fra' END AS ocr_language, CAST(greatest(1, doc_id % 4) AS BIGINT) AS ocr_timeout FROM documents""")
def ocr_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    hints = F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 3 == 1, F.array(F.lit("deu"))).otherwise(F.array(F.lit("deu"), F.lit("fra")))
    text = F.when(d % 3 == 0, " \n").otherwise("x")
    return table(spark, sf_dir, "documents").select("doc_id", files.needs_ocr(d % 2 == 0, text, True).alias("decision"), *files.ocr_settings(hints, d % 4))


@query("""
WITH o AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END AS text, doc_id % 50 = 7 AS bad, doc_id % 5 <> 0 AND doc_id % 4 <> 0 AS same FROM documents),
c AS (SELECT sum(ceil(len(list_filter(string_split(text, ' '), lambda x: x <> '')) / 100.0)) AS n FROM o WHERE NOT bad AND NOT same)
SELECT count(*) FILTER (NOT bad) AS documents, count(*) FILTER (NOT bad AND same) AS skipped, CAST((SELECT n FROM c) AS BIGINT) AS chunks, count(*) FILTER (bad) AS failed FROM o""")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of an ingest of all documents, some of which cannot be read."""
    error = F.when(F.col("doc_id") % 50 == 7, F.lit("cannot be read"))
    new = _incoming(spark, sf_dir).withColumnRenamed("id", "document_id").withColumn("error", error).withColumn("path", F.col("document_id"))
    done = ingest.outcome(new, _stored(spark, sf_dir))
    made = CH.token_chunks(done.where("not skip"), 100, 0.0, "tenant", "document_id")
    return ingest.counters(done, made).select("documents", "skipped", "chunks", "failed")


@query("""
SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN NULL ELSE 't' END AS title, 'x,y' AS tags, round(1.0 / (1 + vec_id), 6) AS score FROM embeddings WHERE vec_id % 5 <> 0""")
def scored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    text = lambda x: F.lit(x).alias(x)
    payload = F.struct(v.cast("string").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), text("text"), F.when(v % 2 == 0, "").otherwise("t").alias("title"), text("source_url"), text("source_domain"), text("language"), text("collection"), text("section_heading"), F.lit('["x","y"]').alias("tags"))
    points = table(spark, sf_dir, "embeddings").select(F.when(v % 5 != 0, v).alias("chunk_id"), payload.alias("payload"), F.round(F.lit(1.0) / (v + 1), 6).alias("score"))
    return R.scored_points(points).select(F.col("chunk_id").cast("long").alias("vec_id"), "title", F.array_join("tags", ",").alias("tags"), "score")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST._counted(table(spark, sf_dir, "events"), F.window("ts", "1 hour"), "event_type").drop("window_end")


@query("""
WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST._counted(table(spark, sf_dir, "events"), F.session_window("ts", "30 minutes"), "user_id").drop("window_end")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a bounded stream in several micro-batches, counted by event type."""
    stream = ST.read_table(spark, f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return ST.collected(stream, f"totals_{uuid.uuid4().hex[:12]}", "complete")


@query(r"""
SELECT doc_id, 'default' AS tenant, 0::BIGINT AS chunk_index, md5(text) AS text_md5, NULL AS title, lang AS language, source AS collection, '["' || lang || '"]' AS tags, CAST(64 AS INTEGER) AS dim, 1.0::DOUBLE AS length FROM documents""")
def index_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide index of one chunk a document, with stand-in vectors, checked for their size."""
    rows = corpus(spark, sf_dir).select("tenant", "collection", "document_id", F.lit(0).alias("chunk_index"), "text", F.lit(None).cast("string").alias("section_heading"))
    meta = corpus(spark, sf_dir).select("tenant", "document_id", F.lit(None).cast("string").alias("title"), F.lit("").alias("source_url"), F.lit("").alias("source_domain"), F.col("lang").alias("language"), F.array(F.col("lang")).alias("tags"))
    chunks = I.with_chunk_ids(rows)
    points = I.check_vectors(I.index_points(chunks, meta, chunks.select("chunk_id", V.mock_embedding(64)("text").alias("dense"))), 64)
    p = F.col("payload")
    return points.select(p["document_id"].cast("long").alias("doc_id"), p["tenant"].alias("tenant"), p["chunk_index"].alias("chunk_index"), F.md5(p["text"]).alias("text_md5"), p["title"].alias("title"), p["language"].alias("language"), p["collection"].alias("collection"), p["tags"].alias("tags"), F.size("dense").alias("dim"), F.round(V.norm("dense"), 4).alias("length"))
