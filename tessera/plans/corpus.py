"""Queries over text functions, chunkers and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import limits as L
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking as CH
from ..operators import index as I
from ..session import spread
from .registry import corpus, query, table

SIZE, OVERLAP = 128, 0.15
#: Token windows of 128 with 19 shared: the SQL twin of ``token_chunks``.
CHUNKS = """
tok AS (SELECT doc_id, source, lang, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents),
cnt AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 128 THEN 1 ELSE CAST(ceil((len(w) - 128) / 109.0) AS INTEGER) + 1 END AS c FROM tok),
win AS (SELECT doc_id, source, lang, w, unnest(range(c)) AS i FROM cnt),
chunks AS (SELECT doc_id, source, lang, CAST(i AS INTEGER) AS chunk_index, array_to_string(w[i * 109 + 1 : i * 109 + 128], ' ') AS text, CAST(len(w[i * 109 + 1 : i * 109 + 128]) AS INTEGER) AS n_tokens FROM win)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(corpus(spark, sf_dir))
    return CH.token_chunks(rows, SIZE, OVERLAP, "doc_id", "tenant", "collection", "document_id", "lang")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, text, n_tokens FROM chunks")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", "text", "n_tokens")


@query(rf"WITH {CHUNKS} SELECT doc_id, chunk_index, regexp_replace(regexp_replace(text, '^\s+', ''), '^\p{{Ll}}\S*\s+', '') AS text FROM chunks WHERE length(regexp_replace(regexp_replace(text, '^\s+', ''), '^\p{{Ll}}\S*\s+', '')) > 0")
def chunk_word_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.normalised_starts(chunks(spark, sf_dir)).select("doc_id", "chunk_index", "text")


@query(f"""
WITH {CHUNKS}, h AS (SELECT doc_id, chunk_index, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('default:' || doc_id || ':' || chunk_index)) AS h FROM chunks)
SELECT doc_id, chunk_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id
FROM h""")
def chunk_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_chunk_ids(chunks(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_id")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))


_PAGES = """
p AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(12)), chr(12))) AS body, generate_subscripts(string_split(replace(text, chr(10), chr(12)), chr(12)), 1) AS page FROM documents),
t AS (SELECT doc_id, CAST(page AS INTEGER) AS page, list_filter(string_split(trim(body), ' '), lambda x: x <> '') AS w FROM p WHERE length(trim(body)) > 0),
"""


@query(f"""
WITH {_PAGES} c AS (SELECT *, CASE WHEN len(w) <= 48 THEN 1 ELSE CAST(ceil((len(w) - 48) / 41.0) AS INTEGER) + 1 END AS c FROM t),
u AS (SELECT doc_id, page, w, unnest(range(c)) AS i FROM c)
SELECT doc_id, page, CAST(i + 1 AS INTEGER) AS chunk, '[page ' || page || ']' || chr(10) || array_to_string(w[i * 41 + 1 : i * 41 + 48], ' ') AS text FROM u""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.page_chunks(_paged(spark, sf_dir), 50, OVERLAP, "doc_id")


@query(f"""
WITH {_PAGES} c AS (SELECT *, CASE WHEN len(w) <= 46 THEN 1 ELSE CAST(ceil((len(w) - 46) / 40.0) AS INTEGER) + 1 END AS c FROM t),
u AS (SELECT doc_id, page, w, unnest(range(c)) AS i FROM c)
SELECT doc_id, page, CAST(i + 1 AS INTEGER) AS chunk, '[page ' || page || ' chunk ' || (i + 1) || ']' || chr(10) || array_to_string(w[i * 40 + 1 : i * 40 + 46], ' ') AS text FROM u""")
def page_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.page_chunks(_paged(spark, sf_dir), 50, OVERLAP, "doc_id", numbered=True)


@query(r"""
WITH s AS (SELECT doc_id, string_split('# ' || lang || chr(10) || replace(text, chr(10), chr(10) || '## '), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM s),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*#{1,6}\s+\S') THEN length(regexp_extract(line, '^\s*(#{1,6})', 1)) END AS level, CASE WHEN regexp_matches(line, '^\s*#{1,6}\s+\S') THEN trim(regexp_extract(line, '^\s*#{1,6}\s+(\S.*)$', 1)) END AS title FROM l),
n AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY ln) AS section FROM m),
g AS (SELECT doc_id, section, max(title) AS title, max(level) AS level, string_agg(line, chr(10) ORDER BY ln) AS text FROM n GROUP BY doc_id, section),
r AS (SELECT *, max(CASE WHEN level = 1 THEN title END) OVER (PARTITION BY doc_id ORDER BY section) AS top FROM g)
SELECT doc_id, section, title, CASE WHEN level = 1 THEN title WHEN level = 2 THEN top || ' > ' || title END AS path, CAST(level AS INTEGER) AS level, trim(text, ' ' || chr(10)) AS text FROM r WHERE length(trim(text, ' ' || chr(10))) > 0""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# "), F.col("lang"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return CH.markdown_sections(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id")


_NAMES = ("MD", "page-aware", "bogus", None, "Characters", " Tokens ")


@query(r"""
WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'MD' WHEN 1 THEN 'page-aware' WHEN 2 THEN 'bogus' WHEN 4 THEN 'Characters' WHEN 5 THEN ' Tokens ' END AS configured, CASE WHEN doc_id % 2 = 0 THEN '# ' || text ELSE text END AS text FROM documents)
SELECT doc_id, CASE lower(trim(configured)) WHEN 'md' THEN 'markdown' WHEN 'page-aware' THEN 'page_tokens' WHEN 'characters' THEN 'chars' WHEN 'tokens' THEN 'tokens'
  ELSE CASE WHEN regexp_matches(text, '(?m)^\s*#{1,6} ') THEN 'markdown' ELSE 'tokens' END END AS strategy FROM c""")
def strategy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in _NAMES))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 6).cast("int")).alias("configured"), text.alias("text"))
    return rows.select("doc_id", CH.selected_strategy("configured", "text").alias("strategy"))


@query(r"""
WITH t AS (SELECT doc_id, repeat('漢字', CAST(doc_id % 97 AS INTEGER)) || text AS x FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(x, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}]')) AS cjk, len(regexp_extract_all(x, '\p{L}')) AS letters FROM t)
SELECT doc_id, CAST(CASE WHEN letters > 0 AND cjk / letters > 0.5 THEN 900 ELSE 600 END AS INTEGER) AS budget FROM n""")
def script_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.repeat(F.lit("漢字"), (F.col("doc_id") % 97).cast("int")), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.script_budget(x, 600).alias("budget"))


@query(r"""
SELECT doc_id, sha256(text) AS checksum, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens, substr(text, 1, 80) AS preview, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.checksum("text").alias("checksum"), T.token_estimate("text").alias("tokens"), T.preview("text").alias("preview"), T.collapse_ws("text").alias("collapsed"))


@query(r"SELECT vec_id, regexp_matches(CASE vec_id % 4 WHEN 0 THEN 'ok-' || vec_id WHEN 1 THEN '' WHEN 2 THEN 'no space' ELSE repeat('x', CAST(vec_id % 300 AS INTEGER)) END, '^[A-Za-z0-9_-]{1,128}$') AS valid FROM embeddings")
def tenant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    name = F.when(v % 4 == 0, F.concat(F.lit("ok-"), v.cast("string"))).when(v % 4 == 1, "").when(v % 4 == 2, "no space").otherwise(F.repeat(F.lit("x"), (v % 300).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", T.valid_tenant(name).alias("valid"))


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.postings(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


@query("""
WITH t AS (SELECT source, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS n FROM documents)
SELECT 'default' AS tenant, source AS collection, count(*) AS total_docs, CAST(sum(n) AS BIGINT) AS total_tokens, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS avgdl FROM t GROUP BY source""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("token_count", T.token_estimate("text"))
    return I.corpus_stats(rows).withColumn("avgdl", F.round("avgdl", 6))


@query("""
WITH w AS (SELECT DISTINCT source AS collection FROM documents UNION ALL SELECT 'absent'),
s AS (SELECT source AS collection, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS t FROM documents GROUP BY source)
SELECT 'default' AS tenant, w.collection, coalesce(n, 0) AS total_docs, coalesce(t, 0) AS total_tokens, round(CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / n ELSE 300.0 END, 6) AS avgdl FROM w LEFT JOIN s ON w.collection = s.collection""")
def average_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("token_count")), "doc_id")
    wanted = rows.select("tenant", "collection").distinct().union(spark.createDataFrame([("default", "absent")], "tenant string, collection string"))
    return I.average_length(I.corpus_stats(rows), wanted, 300.0).withColumn("avgdl", F.round("avgdl", 6))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS length, CAST(len(embedding) AS INTEGER) AS dim, 1.0::DOUBLE AS unit FROM embeddings")
def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.check_vectors(table(spark, sf_dir, "embeddings"), 64, "embedding")
    return v.select("vec_id", F.round(V.norm("embedding"), 5).alias("length"), F.size("embedding").alias("dim"), F.round(V.norm(V.normalised("embedding")), 5).alias("unit"))


@query()
def chunk_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy over every document, in Arrow batches."""
    names = F.array(*(F.lit(s) for s in CH.P.STRATEGIES))
    rows = spread(corpus(spark, sf_dir)).withColumn("strategy", F.explode(names))
    return CH.chunked(rows, 64, OVERLAP, tokenizer="words", keep=("doc_id", "strategy"))


def _started(raw: str) -> str:
    return rf"regexp_replace(regexp_replace({raw}, '^\s+', ''), '^\p{{Ll}}\S*\s+', '')"


_WORDS = r"regexp_extract_all({}, '\s*\S+|\s+$')"


def _packed(spark: SparkSession, sf_dir: str, strategy: str, pages: bool) -> DataFrame:
    """The chunks that ingest makes by one strategy, budgets counted in words."""
    rows = spread(_paged(spark, sf_dir) if pages else table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = CH.chunked(rows.withColumn("strategy", F.lit(strategy)), 64, OVERLAP, tokenizer="words", keep=("doc_id",))
    return made.select("doc_id", "chunk_index", "text")


@query(f"""
WITH t AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 9), 55)) AS i FROM t WHERE len(w) > 0),
x AS (SELECT doc_id, i, {_started("array_to_string(w[i + 1 : i + 64], '')")} AS text FROM c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, text FROM x WHERE length(text) > 0""")
def packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "tokens", False)


@query(f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM documents),
r AS (SELECT doc_id, list_reduce(list_prepend({{'o': []::VARCHAR[], 'l': '', 'u': 0::BIGINT, 'w': '', 'n': 0::BIGINT}}, list_transform(ws, lambda w: {{'o': []::VARCHAR[], 'l': '', 'u': 0::BIGINT, 'w': w, 'n': octet_length(encode(w))}})),
        lambda a, x: CASE WHEN a.l <> '' AND a.u + x.n + 1 > 400
          THEN {{'o': list_append(a.o, trim(a.l)), 'l': right(trim(a.l), 60) || x.w || ' ', 'u': octet_length(encode(right(trim(a.l), 60))) + x.n + 1, 'w': '', 'n': 0::BIGINT}}
          ELSE {{'o': a.o, 'l': a.l || x.w || ' ', 'u': a.u + x.n + 1, 'w': '', 'n': 0::BIGINT}} END) AS s FROM d WHERE len(ws) > 0),
c AS (SELECT doc_id, list_append(s.o, trim(s.l)) AS parts FROM r),
x AS (SELECT doc_id, i, {_started("parts[i]")} AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM c))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, text FROM x WHERE length(text) > 0""")
def packed_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under a byte budget, each chunk after the last characters of the one before."""
    return _packed(spark, sf_dir, "chars", False)


@query(f"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda p: p <> '') AS ps FROM documents),
w AS (SELECT doc_id, list_transform(ps, lambda p: {{'p': p, 'w': {_WORDS.format('p')}}}) AS ps FROM d WHERE len(ps) > 0),
m AS (SELECT doc_id, list_transform(ps, lambda x: CASE WHEN len(x.w) > 64
        THEN {{'o': list_transform(range(0, greatest(1, len(x.w) - 9), 55), lambda i: array_to_string(x.w[i + 1 : i + 64], '')), 'h': NULL::VARCHAR, 'u': 0::BIGINT}}
        ELSE {{'o': []::VARCHAR[], 'h': x.p, 'u': len(x.w)}} END) AS ps FROM w),
r AS (SELECT doc_id, list_reduce(list_prepend({{'o': []::VARCHAR[], 'h': NULL::VARCHAR, 'u': 0::BIGINT}}, ps),
        lambda a, x: CASE WHEN x.h IS NULL THEN {{'o': list_concat(list_concat(a.o, CASE WHEN a.h IS NULL THEN []::VARCHAR[] ELSE [a.h] END), x.o), 'h': NULL::VARCHAR, 'u': 0::BIGINT}}
          WHEN a.h IS NULL THEN {{'o': a.o, 'h': x.h, 'u': x.u}}
          WHEN a.u + 1 + x.u <= 64 THEN {{'o': a.o, 'h': a.h || chr(10) || chr(10) || x.h, 'u': a.u + 1 + x.u}}
          ELSE {{'o': list_append(a.o, a.h), 'h': x.h, 'u': x.u}} END) AS s FROM m),
c AS (SELECT doc_id, list_concat(s.o, CASE WHEN s.h IS NULL THEN []::VARCHAR[] ELSE [s.h] END) AS parts FROM r),
x AS (SELECT doc_id, i, {_started("parts[i]")} AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM c))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, text FROM x WHERE length(text) > 0""")
def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a paragraph, packed under a budget of words; long ones in windows."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text")))
    made = CH.chunked(rows.withColumn("strategy", F.lit("paragraphs")), 64, OVERLAP, tokenizer="words", keep=("doc_id",))
    return made.select("doc_id", "chunk_index", "text")


def _packed_pages(room: int, step: int, label: str) -> str:
    """The SQL twin of page chunkers: documents of one page are cut into plain windows."""
    return f"""
WITH d AS (SELECT doc_id, replace(text, chr(10), chr(12)) AS text FROM documents),
p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS body, generate_subscripts(string_split(text, chr(12)), 1) AS page FROM d WHERE contains(text, chr(12))),
q AS (SELECT doc_id, page, trim(body, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM p),
w AS (SELECT doc_id, page, {_WORDS.format('body')} AS w FROM q WHERE length(body) > 0),
c AS (SELECT doc_id, page, w, unnest(range(0, greatest(1, len(w) - {room} + {step}), {step})) AS i FROM w),
n AS (SELECT doc_id, page, i, w, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS k FROM c),
l AS (SELECT doc_id, page, i, {label} || chr(10) || array_to_string(w[i + 1 : i + {room}], '') AS raw FROM n
  UNION ALL SELECT doc_id, 0, i, array_to_string(w[i + 1 : i + 64], '') FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 9), 55)) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM d WHERE NOT contains(text, chr(12))) WHERE len(w) > 0)),
x AS (SELECT doc_id, page, i, {_started('raw')} AS text FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS INTEGER) AS chunk_index, text FROM x WHERE length(text) > 0"""


@query(_packed_pages(61, 52, "'[page ' || page || ']'"))
def packed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "pages", True)


@query(_packed_pages(59, 51, "'[page ' || page || ' chunk ' || k || ']'"))
def packed_page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "page_tokens", True)


@query()
def mock_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.mock_embedding(64)("text").alias("embedding"))


@query("""
WITH n AS (SELECT source, doc_id // 1000 AS part, doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS t FROM documents),
g AS (SELECT source, part, list(doc_id ORDER BY doc_id) AS ids, list(t ORDER BY doc_id) AS ts FROM n GROUP BY source, part),
f AS (SELECT source, part, ids, ts, list_reduce(list_prepend({'t': 0::BIGINT, 'n': 0, 'b': 0, 'o': []::INTEGER[]}, list_transform(ts, lambda x: {'t': x, 'n': 0, 'b': 0, 'o': []::INTEGER[]})),
  lambda a, x: CASE WHEN a.n > 0 AND (a.t + x.t > 8192 OR a.n >= 32) THEN {'t': x.t, 'n': 1, 'b': a.b + 1, 'o': list_append(a.o, a.b + 1)} ELSE {'t': a.t + x.t, 'n': a.n + 1, 'b': a.b, 'o': list_append(a.o, a.b)} END).o AS o FROM g),
u AS (SELECT source, part, unnest(ids) AS doc_id, unnest(ts) AS t, unnest(o) AS batch FROM f)
SELECT source, CAST(part AS BIGINT) AS part, CAST(batch AS INTEGER) AS batch, min(doc_id) AS first_id, count(*) AS items, CAST(sum(t) AS BIGINT) AS tokens FROM u GROUP BY source, part, batch""")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 8192 tokens and 32 items, in ranges of a thousand ids of each source; a larger text is alone."""
    rows = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", T.token_estimate("text").alias("t"))
    lists = rows.groupBy("source", "part").agg(F.sort_array(F.collect_list(F.struct("doc_id", "t"))).alias("x"))
    packed = lists.select("source", "part", "x", F.posexplode(L.pack_ranges(F.col("x.t"), 8192, 32)).alias("batch", "b"))
    held = F.slice("x", F.col("b.first") + 1, F.col("b.until") - F.col("b.first"))
    return packed.withColumn("held", held).select("source", "part", "batch", F.get("held", F.lit(0))["doc_id"].alias("first_id"), F.size("held").cast("long").alias("items"), F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["t"]).alias("tokens"))


@query("""
WITH r AS (SELECT doc_id, source, sha256(text) AS checksum FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY checksum) AS first_id, row_number() OVER (PARTITION BY checksum ORDER BY doc_id) > 1 AS skip FROM r""")
def checksum_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("checksum")
    rows = table(spark, sf_dir, "documents").select("doc_id", T.checksum("text").alias("checksum"))
    return rows.select("doc_id", F.min("doc_id").over(w).alias("first_id"), (F.row_number().over(w.orderBy("doc_id")) > 1).alias("skip"))
