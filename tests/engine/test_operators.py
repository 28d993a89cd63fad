import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import limits as L
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import access, agents, chat, evals, layout, retrieval, stores
from tessera.operators import context as C
from tessera.operators import fusion as FU
from tessera.operators import index as I
from tessera.sources import specs
from tessera.streaming import events as ST


def test_uuid5_equals_the_standard(spark):
    names = ["t:doc:0", "default:漢字:12", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.uuid5("n").alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_OID, r.n)) for r in rows)


def test_text_functions(spark):
    df = spark.createDataFrame([("\u3000 a  b\n", "Äpfel hello-WORLD 12")], "x string, y string")
    r = df.select(T.trim_ws("x").alias("t"), T.collapse_ws("x").alias("c"), T.terms("y").alias("w"), T.token_estimate("y").alias("n"), T.format_score(F.lit(1.005)).alias("s"), T.render_template("{{a}}|{{{a}}}", a=F.lit("<&>")).alias("r")).first()
    assert (r.t, r.c, r.w, r.n, r.r) == ("a  b", "a b", ["äpfel", "hello", "world", "12"], 6, "&lt;&amp;&gt;|<&>")
    with pytest.raises(KeyError):
        T.render_template("{{b}}", a=F.lit(1))


def test_bm25_weights(spark):
    docs = spark.createDataFrame([("d1", "alpha beta alpha"), ("d2", "alpha alpha"), ("d3", "Hello, WORLD!"), ("d4", "")], "chunk_id string, text string")
    post = {(r.chunk_id, r.term): (r.tf, r.length) for r in I.postings(docs).collect()}
    assert post == {("d1", "alpha"): (2, 3), ("d1", "beta"): (1, 3), ("d2", "alpha"): (2, 2), ("d3", "hello"): (1, 2), ("d3", "world"): (1, 2)}
    q = spark.createDataFrame([(1, "alpha beta"), (2, "hello world"), (3, "!!")], "query_id int, query string")
    got = retrieval.sparse_topk(q, I.postings(docs), docs.agg(F.count(F.lit(1)).alias("n"))).collect()
    assert [r.chunk_id for r in sorted((x for x in got if x.query_id == 1), key=lambda r: r.rank)] == ["d1", "d2"]
    assert {r.query_id for r in got} == {1, 2}
    w = lambda tf, n, b: tf * 2.2 / (tf + 1.2 * (1 - b + b * n / 300))
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    want = w(1, 2, 0.3) * idf(2) * w(2, 3, 0.75) + w(1, 2, 0.3) * idf(1) * w(1, 3, 0.75)
    assert next(r.score for r in got if r.chunk_id == "d1") == pytest.approx(want, abs=1e-8)


HITS = "query_id int, source string, source_order int, rank int, chunk_id string, document_id string, chunk_index int, text string, title string, tags array<string>, score double"


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "dense", 0, 1, "c1", "d1", 0, "x", None, [], 0.9), (1, "dense", 0, 2, "c2", "d1", 1, "y", None, [], 0.8), (1, "sparse", 1, 1, "c3", "d2", 0, "z", None, [], 0.7), (1, "sparse", 1, 2, "c1", "d1", 0, "x", "T", ["a"], 0.6)], HITS)
    got = FU.fuse(hits).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c1", "c3", "c2"]
    assert got[0].fused_score == pytest.approx(1 / 61 + 1 / 62) and got[0].sources == ["dense", "sparse"] and got[0].source_scores == {"dense": 0.9, "sparse": 0.6}
    assert got[0].title == "T" and got[0].tags == ["a"]
    assert FU.fuse(hits.limit(0)).count() == 0


FUSED = "query_id int, chunk_id string, document_id string, chunk_index int, text string, fused_score double, sources array<string>"


def test_context(spark):
    rows = [(1, "c1", "d1", 0, "small", 0.9, ["dense"]), (1, "c2", "d1", 1, "b" * 500, 0.8, ["dense"]), (1, "c3", "d2", 0, "b" * 500, 0.7, ["sparse"]), (1, "c4", "d3", 0, "end", 0.6, ["sparse"])]
    df = spark.createDataFrame(rows, FUSED)
    one = C.rendered(C.build(df, 100, 50)).first()
    assert [c.chunk_id for c in one.chunks] == ["c1", "c4"] and one.context == "[1] small\n---\n[2] end"
    assert one.stats.asDict() == {"input_count": 4, "after_dedupe": 3, "final_count": 2, "dedupe_dropped": 1, "budget_dropped": 1}
    assert [c.sources for c in one.citations] == [["dense"], ["sparse"]]
    assert [c.chunk_id for c in C.build(df, 10_000, 2, "none").first().chunks] == ["c1", "c2"]
    assert C.build(df, 10_000, 9, "chunk", citations=False).first().citations == []
    with pytest.raises(ValueError):
        C.build(df, 1, 1, "other")


def test_search_syntax(spark):
    p = retrieval.parse_search('"rotate keys" alpha or beta -gamma')
    assert p == {"groups": [[["rotate", "keys"]], [["alpha"], ["beta"]]], "negated": [["gamma"]]}
    docs = spark.createDataFrame([(1, "Rotate keys, alpha"), (2, "keys rotate beta"), (3, "rotate keys beta gamma"), (4, "please rotate keys BETA")], "id int, text string")
    assert sorted(r.id for r in retrieval.fts_matches(docs, '"rotate keys" alpha or beta -gamma').collect()) == [1, 4]
    assert retrieval.fts_matches(docs, " !? ").count() == 0
    assert retrieval.cover_density({"a": [0, 9], "b": [1]}, ["a", "b"]) > retrieval.cover_density({"a": [0], "b": [5]}, ["a", "b"]) > 0


def test_vectors(spark):
    got = spark.createDataFrame([("a",), ("b",), (None,)], "t string").select("t", V.mock_embedding(16)("t").alias("v")).collect()
    assert got[2].v is None and np.allclose(np.linalg.norm([got[0].v, got[1].v], axis=1), 1, atol=1e-5) and got[0].v != got[1].v
    state = int.from_bytes(__import__("hashlib").sha256(b"a").digest()[:8], "little")
    first = []
    for _ in range(16):
        state ^= state << 13 & (2**64 - 1)
        state ^= state >> 7
        state ^= state << 17 & (2**64 - 1)
        first.append(state / (2**64 - 1) * 2 - 1)
    assert np.allclose(got[0].v, np.array(first) / np.linalg.norm(first), atol=1e-5)
    with pytest.raises(ValueError):
        V.model_dim("other")


def test_limits(spark):
    df = spark.createDataFrame([([5, 5, 5, 1, 9],), ([],)], "c array<int>")
    assert [[tuple(b) for b in r.b] for r in df.select(L.pack_ranges("c", 10, 2).alias("b")).collect()] == [[(0, 2), (2, 4), (4, 5)], []]
    assert L.override(None, 5, "k") == 5 and L.override(3, 5, "k") == 3
    with pytest.raises(ValueError):
        L.override(0, 5, "k")
    assert [r[0] for r in spark.range(3).select(L.backoff_ms(F.col("id"), 100, 250)).collect()] == [100, 200, 250]


def test_history_and_turns(spark):
    rows = [(1, 1, "system", "s"), (1, 2, "user", "a"), (1, 3, "user", "b"), (1, 4, "assistant", "c"), (1, 5, "user", "d")]
    m = spark.createDataFrame(rows, "conversation_id int, id int, role string, content string").withColumn("created_at", F.col("id"))
    assert [r.content for r in chat.model_history(m, 4).orderBy("position").collect()] == ["a", "b", "c", "d"]
    assert [r.content for r in chat.model_history(m, 5).orderBy("position").collect()] == ["a", "b", "c", "d"]
    merged = chat.coalesced(chat.model_history(m, 5)).orderBy("turn").collect()
    assert [(r.role, r.content) for r in merged] == [("user", "a\nb"), ("assistant", "c"), ("user", "d")]
    with pytest.raises(ValueError):
        chat.latest_messages(m, 0)


def test_token_bucket(spark):
    rows = [(i, "k", float(i) * 0.001) for i in range(7)] + [(100, "k", 5.0), (200, "other", 0.0)]
    log = spark.createDataFrame(rows, "event_id long, key string, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    got = {r.event_id: r.allowed for r in access.token_bucket(log, 10.0, 5.0, "key").collect()}
    assert [got[i] for i in range(7)] == [True] * 5 + [False] * 2 and got[100] and got[200]


def test_token_bucket_parts_over_slots_of_time(spark):
    """Parts of random histories, cut by slots of any length, against a walk over each key."""
    r = __import__("random").Random(8)
    rows, i = [], 0
    for key in ("a", "b", None):
        t = 0.0
        for _ in range(120):
            t += r.choice([0.0, 0.125, 0.25, 0.5, 2.0, 9.0])
            rows.append((i, key, t))
            i += 1
    want, last = {}, {}
    for n, key, t in rows:
        before, part = last.get(key, (None, 0))
        part += before is None or (t - before) * 4.0 >= 2.0
        last[key] = t, part
        want[n] = part
    log = spark.createDataFrame(rows, "event_id long, key string, at double").repartition(3)
    for slot_s in (0.3, 1.0, 1000.0):
        got = access.refilled_parts(log, 4.0, 2.0, "key", at="at", order="event_id", slot_s=slot_s).collect()
        assert {x.event_id: x.bucket_part for x in got} == want and len(got) == len(rows)


def test_keys(spark):
    token, prefix, stored = access.generate_key()
    assert access.verify_secret(token.split("_")[2], stored) and not access.verify_secret("x", stored)
    r = spark.createDataFrame([(token,), ("tk_a_b_c",), ("tk__x",), (None,)], "t string").select(access.parsed_key("t").alias("k")).collect()
    assert r[0].k.prefix == prefix and r[1].k.secret == "b_c" and r[2].k is None and r[3].k is None


SPANS = "page_id int, text string, font_size double, is_bold boolean, x_position double, y_position double, x_end double"


def test_layout(spark):
    body = [(1, "Ordinary body text of the page here.", 10.0, False, 0.0, 100.0 - 12 * i, 200.0) for i in range(6)]
    top = [(1, "Great", 24.0, False, 0.0, 700.0, 50.0), (1, "Title", 24.0, False, 60.0, 701.0, 90.0), (1, "Sub-", 12.5, False, 0.0, 500.0, 30.0), (1, "part", 12.5, False, 31.0, 500.0, 60.0), (1, "Bold point", 11.0, True, 0.0, 400.0, 70.0), (2, "x", 9.0, False, 0.0, 0.0, 1.0)]
    spans = spark.createDataFrame([*top, *body], SPANS)
    found = layout.headings(spans).orderBy("line").collect()
    assert [(r.level, r.text) for r in found] == [(1, "Great Title"), (3, "Sub-part"), (3, "Bold point")]
    pages = spark.createDataFrame([(1, "Great  Title\nbody Great Title\nSub-part\nmore"), (3, "same")], "page_id int, text string")
    got = {r.page_id: r.text for r in layout.with_headings(pages, spans).collect()}
    assert got == {1: "\n# Great  Title\n\nbody Great Title\n\n### Sub-part\n\nmore", 3: "same"}


def test_agents_pause_and_resume(spark):
    hits = spark.createDataFrame([(1, "c1", "d1", 0, "evidence", 0.5, ["dense"])], FUSED).withColumn("rank", F.lit(1))
    runs = spark.createDataFrame([("r1", "t", 1, "what is it"), ("r2", "t", 2, "select x")], "run_id string, tenant string, query_id int, query string")
    tasks = agents.retrieval_tasks(hits)
    paused = agents.execute(specs.APPROVED, runs, tasks).cache()
    assert {(r.run_id, r.status, len(r.steps)) for r in paused.collect()} == {("r1", "waiting", 4), ("r2", "waiting", 4)}
    said = spark.createDataFrame([("r1", "t", "approve", None), ("r2", "other", "approve", None)], "run_id string, tenant string, decision string, reason string")
    ready = agents.decided(paused, said)
    assert [r.run_id for r in ready.collect()] == ["r1"]
    done = agents.execute(specs.APPROVED, ready.select("run_id", "tenant", "query_id", "query", "decision", "reason"), tasks).first()
    assert done.status == "completed" and done.final_answer.startswith("Mock answer")
    short = agents.execute(specs.ROUTED, runs, tasks, max_steps=1).collect()
    assert {r.status for r in short} == {"failed"}
    with pytest.raises(ValueError):
        agents.execute(specs.ROUTED, runs, {})


def test_evals(spark):
    cases = spark.createDataFrame([("a", "What is Rust?", "single_pass_rag", "simple_fact", ["d1"]), ("b", "Compare x and y", "agentic_search", "multi_hop_research", ["d1", "d2"])], "id string, query string, expected_route string, expected_query_class string, expected_evidence array<string>")
    found = spark.createDataFrame([("a", "d1"), ("b", "d2")], "id string, document_id string")
    s = evals.summary(evals.route_agreement(cases), evals.evidence_recall(cases, found)).first()
    assert (s.route_agreement, s.pass_rate, s.mean_recall) == (1.0, 0.5, 0.75)
    assert all(r.as_good for r in evals.compared(found, found, cases).collect())


def test_stats_follow_deltas(spark):
    schema = "tenant string, stats_collection string, stats_token_count long"
    before = spark.createDataFrame([("t", "a", 10), ("t", "a", 5)], schema)
    after = spark.createDataFrame([("t", "b", 10), ("t", None, None)], schema)
    stats = spark.createDataFrame([("t", "a", 2, 15)], "tenant string, collection string, total_docs long, total_tokens long")
    got = {r.collection: (r.total_docs, r.total_tokens, r.avgdl) for r in stores.apply_deltas(stats, stores.stats_deltas(before, after)).collect()}
    assert got == {"a": (0, 0, 0.0), "b": (1, 10, 10.0)}


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = events.groupBy(F.window("ts", "1 hour").start.alias("s")).count().count()
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    stream = ST.tumbling(ST.read_table(spark, path, 1), "1 hour", "400 days")
    assert ST.collected(stream, "hours", "complete").count() == batch
    once = ST.deduplicated(ST.read_table(spark, path))
    assert ST.collected(once, "once").count() == events.count()
    limited = ST.limited(ST.read_table(spark, path), "user_id", 1e-9, 2.0)
    got = ST.collected(limited, "limited")
    assert got.count() == events.count() and got.where("allowed").groupBy("user_id").count().agg(F.max("count")).first()[0] <= 2
    seen = []
    ST.ingest_stream(ST.read_table(spark, path), lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == events.count()


def test_request_rules(spark):
    from tessera.operators import requests as Q

    rows = spark.createDataFrame([("User",), ("user",), (None,), ("TOKENS",), ("OpenAI",)], "x string")
    read = lambda kind: [tuple(r.p) for r in rows.select(Q.parsed_name(kind, "x").alias("p")).collect()]
    assert [v for v, _ in read("message_role")] == [None, "user", None, None, None] and read("message_role")[0][1] == "unknown message role: User"
    assert [v for v, _ in read("strategy")] == [None, None, None, "tokens", None] and read("llm_provider")[4] == ("openai-compatible", None)
    h = spark.createDataFrame([("Bearer a ", "k"), ("Basic a", " k "), (None, None), ("Bearer ", "k")], "a string, k string")
    assert [r[0] for r in h.select(Q.header_token("a", "k")).collect()] == ["a", "k", None, ""]
    assert [r[0] for r in spark.createDataFrame([("unknown run 7",), ("cannot resume",), ("else",)], "m string").select(Q.run_error_status("m")).collect()] == [404, 400, 500]
    steps = spark.sql("SELECT 'r' AS run_id, 't' AS task_id, timestamp'2024-05-06 07:08:09' AS started_at, 5L AS elapsed_ms, 'Paused' AS status")
    assert tuple(Q.step_responses(steps).first()) == ("r", "t", "2024-05-06T07:08:09+00:00", 5, "paused")


def test_readiness_and_signing_keys():
    import time

    from tessera.operators import requests as Q

    assert Q.readiness({"store": lambda: 1, "index": lambda: 2}) == {"ready": True, "checks": {"store": "ok", "index": "ok"}}
    told = Q.readiness({"store": lambda: 1 / 0, "index": lambda: time.sleep(0.5)}, 0.05)
    assert told == {"ready": False, "checks": {"store": "store unavailable", "index": "timeout after 0.05s"}}
    now, asked = [0.0], []

    def fetch(issuer):
        asked.append(issuer)
        return {"k1": 1} if len(asked) < 3 else {"k2": 2}

    cache = Q.KeyCache(fetch, 10, lambda: now[0])
    assert [cache.key("k1", "i") for _ in range(3)] == [1, 1, 1] and len(asked) == 1
    now[0] = 10.0
    assert cache.key("k1", "i") == 1 and len(asked) == 2
    assert cache.key("k2", "i") == 2 and len(asked) == 3
    with pytest.raises(KeyError):
        cache.key("k1", "i")


def test_stored_full_text_equals_scans(spark, tmp_path):
    from tessera.operators import stored

    r = __import__("random").Random(5)
    docs = [(str(i), " ".join(r.choice(["of", "the", "and", "Rotate", "keys", "x,y", "ON", "a"]) for _ in range(r.randint(0, 25)))) for i in range(80)] + [("n", None)]
    units = spark.createDataFrame(docs, "key string, text string")
    index = stored.read(spark, stored.write(units, f"file://{tmp_path}/index"))
    searches = list(enumerate(['"of the" and', "rotate -keys", '"rotate keys" or "on a" the', "-the", "!?", '"the the" -"of and"', "nowhere", "x or y -a"]))
    got = {(x.query_id, x.key) for x in retrieval.stored_matches(searches, index).collect()}
    want = {(i, x.key) for i, q in searches for x in retrieval.fts_matches(units.where("text is not null"), q).collect()}
    assert {x for x in got if x[1] != "n"} == want and len(got) == retrieval.stored_matches(searches, index).count()
    ranked = retrieval.stored_fts(searches[:1], index, 80).orderBy("rank").collect()
    places = {k: {} for k, _ in docs}
    for k, t in docs:
        for i, w in enumerate(__import__("re").findall("[a-z]+", (t or "").lower())):
            places[k].setdefault(w, []).append(i)
    assert [(x.key, round(x.score, 9)) for x in ranked] == sorted(((k, round(retrieval.cover_density(places[k], ["of", "the", "and"]), 9)) for i, k in want if i == 0), key=lambda x: (-x[1], x[0]))
    q = spark.createDataFrame([(1, "rotate keys the"), (2, "on")], "query_id int, query string")
    scan = retrieval.sparse_topk(q, I.postings(units, "key"), units.agg(F.count(F.lit(1)).alias("n")), key="key").collect()
    assert sorted((x.query_id, x.key, x.rank, round(x.score, 8)) for x in scan) == sorted((x.query_id, x.key, x.rank, round(x.score, 8)) for x in retrieval.stored_topk(q, index).collect())


def test_dense_products_equal_shards(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 8)).astype(np.float32)
    x[5:60] = x[5]
    rows = [(f"c{i}", v.tolist()) for i, v in enumerate(x)] + [("z", [0.0] * 8), ("n", None), ("d", [1.0, 2.0]), ("m", [None] * 8)]
    points = spark.createDataFrame(rows, "chunk_id string, vector array<float>").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in (5, 70, 200)] + [(900, [2.0, 4.0]), (901, None), (902, [0.0] * 8)], "query_id int, vector array<float>")
    keep = lambda df: sorted((a.query_id, a.chunk_id, a["rank"], round(a.score, 8)) for a in df.collect())
    assert keep(retrieval.dense_topk(q, points, 7)) == keep(retrieval.sharded_topk(q, points.where("chunk_id != 'm'"), 7))


def test_sections_equal_the_packer(spark):
    from tessera.functions import packing as P
    from tessera.operators import chunking as CH

    r = __import__("random").Random(8)
    texts = ["\n".join(r.choice(["# One", "## Two", "### Three", "#### Four", "text here", "###### Six", " ## In", "", "#no"]) for _ in range(r.randint(1, 25))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for x in CH.markdown_sections(rows, "doc_id").orderBy("doc_id", "section").collect():
        got.setdefault(x.doc_id, []).append((x.text, x.path, x.level))
    for i, t in enumerate(texts):
        if len(got.get(i, [])) > 1:  # with one section or none the packer also cuts at marks that are no headings
            assert got[i] == [(body, s.path, s.level) for body, s in P.sections(t)]
