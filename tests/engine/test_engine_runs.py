import pytest

from tessera.engine import Engine
from tessera.sources import specs


def test_profiles_and_agent_runs(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", dim=8)
    long = " ".join(f"Part {i} of the manual tells how valves are closed." for i in range(400))
    docs = {"keys": "Keys rotate every month. The keys are checked.", "memory": "Memory is shared by all services.", "manual": long}
    engine.ingest_rows(spark.createDataFrame(list(docs.items()), "document_id string, text string"), "t", "c")
    asked = spark.createDataFrame([("1", "keys rotate"), ("2", "valves closed")], "query_id string, query string")

    def found(profile):
        out = {}
        for r in sorted(engine.retrieve(asked, "t", "c", profile, dense_k=1, sparse_k=2).collect(), key=lambda r: (r.query_id, r["rank"])):
            out.setdefault(r.query_id, []).append((r.chunk_id, r.document_id, r.chunk_index, r["rank"], r.text))
        return out

    hybrid = {}
    for r in engine.search_hybrid(asked, "t", "c", dense_k=1, sparse_k=2).orderBy("query_id", "rank").collect():
        hybrid.setdefault(r.query_id, []).append(r.chunk_id)
    simple = found("simple_hybrid")
    assert {q: [h[0] for h in hits] for q, hits in simple.items()} == hybrid
    first = found("lexical_first")
    texts = {r.chunk_id for r in engine.search_text(asked, "t", "c").where("query_id = '1'").collect()}
    assert first["1"][0][0] in texts and first["1"][0][1] == "keys" and [h[3] for h in first["1"]] == list(range(1, len(first["1"]) + 1))
    assert len({h[0] for h in first["1"]}) == len(first["1"]) and set(hybrid["1"]) <= {h[0] for h in first["1"]}
    wide = found("broad_then_expand")
    assert [h[0] for h in wide["2"]][: len(hybrid["2"])] == hybrid["2"] and len(wide["2"]) > len(hybrid["2"]) and all(h[4] for h in wide["2"])
    anchors = {(h[1], h[2]) for h in simple["2"]}
    assert all(any(d == h[1] and abs(i - h[2]) <= 1 for d, i in anchors) for h in wide["2"])
    with pytest.raises(ValueError):
        engine.retrieve(asked, "t", "c", "none")

    requests = spark.createDataFrame([("r1", "Compare keys and memory"), ("r2", "what are keys")], "run_id string, query string")
    done = {r.run_id: r for r in engine.run_agents(specs.ROUTED, requests, "t", "c").collect()}
    assert {r.status for r in done.values()} == {"completed"} and "retrieve_evidence" in done["r1"].steps and "baseline_answer" in done["r2"].steps
    assert done["r2"].final_answer == "Mock answer to: what are keys"
    engine.run_agents(specs.APPROVED, requests.where("run_id = 'r1'").selectExpr("'w1' as run_id", "query"), "t", "c")
    assert [(r.run_id, r.status) for r in engine.runs("t").collect()] == [("r1", "completed"), ("r2", "completed"), ("w1", "waiting")]
    said = spark.createDataFrame([("w1", "approve", None), ("r1", "approve", None)], "run_id string, decision string, reason string")
    assert engine.decide(specs.APPROVED, said, "other", "c").count() == 0
    after = engine.decide(specs.APPROVED, said, "t", "c").collect()
    assert [(r.run_id, r.status) for r in after] == [("w1", "completed")] and after[0].final_answer.startswith("Mock answer")
    assert [(r.run_id, r.status) for r in engine.runs("t", "approved_answer").collect()] == [("w1", "completed")] and engine.runs("u").count() == 0
