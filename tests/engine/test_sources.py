import json
import math

import pytest

from tessera.sources import config, files, specs

SIDE = {"schema_version": 1, "document": {"title": "T", "category": "c"}, "source": {"url": "u", "domain": "d", "publisher": "p"}, "language": "en", "tags": ["x"], "acl": {"allow_roles": ["viewer"]}, "security": {"classification": "public"}, "provenance": {"retrieved_at": "now", "retrieved_by": "me"}}


def test_folder_tree(spark, tmp_path):
    (tmp_path / "sub" / ".cache").mkdir(parents=True)
    for name, text in {"doc.txt": "Hello wörld", "readme.md": "# Hi", ".hidden.txt": "no", "image.png": "no", "noext": "no", "sub/.cache/x.txt": "no", "sub/paper.pdf": "%PDF", "doc.metadata.json": json.dumps(SIDE), "orphan.metadata.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    got = {r.stem: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"doc", "readme", "paper", "bad"}
    assert got["doc"].text == "Hello wörld" and got["doc"].sidecar.document.title == "T" and got["doc"].error is None
    assert got["readme"].text == "# Hi" and got["readme"].sidecar is None
    assert "extractor" in got["paper"].error and "UTF-8" in got["bad"].error and got["bad"].text is None
    assert files.inside_roots(str(tmp_path / "doc.txt"), [str(tmp_path)]) and not files.inside_roots(str(tmp_path), []) and not files.inside_roots("/etc/passwd", [str(tmp_path)])


def test_ingest_end_to_end(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.functions import vectors as V
    from tessera.operators import ingest

    (tmp_path / "a.txt").write_text("One two three. " * 40)
    (tmp_path / "b.md").write_text("# Head\n\nBody text here.")
    (tmp_path / "b.metadata.json").write_text(json.dumps(SIDE | {"ingestion": {"collection": "mine"}}))
    (tmp_path / "c.txt").write_bytes(b"\xff")
    docs = ingest.prepared(files.documents(spark, str(tmp_path)), "t")
    stored = spark.createDataFrame([("t", "a", "other")], "tenant string, id string, checksum string")
    done = ingest.outcome(docs, stored).cache()
    chunks = ingest.chunk_rows(done, 20, 0.0, tokenizer="words").cache()
    assert {r.document_id: r.collection for r in done.collect()} == {"a": "demo", "b": "mine", "c": "demo"}
    assert chunks.where("document_id = 'b'").first().section_title == "Head"
    points = ingest.index_rows(chunks, done, lambda c: V.mock_embedding(8)(c)).collect()
    assert len(points) == chunks.count() and all(len(p.dense) == 8 and math.isclose(sum(x * x for x in p.dense), 1, rel_tol=1e-4) for p in points)
    n = ingest.counters(done, chunks).first()
    assert (n.documents, n.skipped, n.chunks, n.failed) == (2, 0, chunks.count(), 1)
    assert ingest.failures(done).count() == 1
    again = ingest.outcome(docs, ingest.stored_documents(done, chunks))
    assert {r.document_id for r in again.where(F.col("skip")).collect()} == {"a", "b", "c"}


def test_settings(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('[tessera]\nchunk_tokens = 100\nbm25_b = 0.5\n')
    s = config.load(str(path), {"TESSERA_CHUNK_TOKENS": "200", "TESSERA_INGEST_ROOTS": "/a:/b"})
    assert (s.chunk_tokens, s.bm25_b, s.rrf_k, s.ingest_roots) == (200, 0.5, 60, ("/a", "/b"))
    for env in ({"TESSERA_RRF_K": "0"}, {"TESSERA_BM25_B": "1.5"}, {"TESSERA_CHUNK_OVERLAP": "1"}, {"TESSERA_CHUNK_TOKENS": "x"}):
        with pytest.raises(ValueError):
            config.load(None, env)
    path.write_text("strange = 1")
    with pytest.raises(ValueError, match="strange"):
        config.load(str(path), {})


SPEC = """
agent_id: "{{ name }}"
description: d
spec_version: "1.0"
tasks: [a, b, c]
graph:
  start_task: a
  tasks: [a, b, c]
  edges: [{from: a, to: b, condition_key: k}, {from: a, to: c}, {from: b, to: c}]
checkpoints: [{checkpoint_id: x, after_task: b}]
"""


def test_specs(tmp_path):
    s = specs.read_spec(SPEC, {"name": "agent"})
    assert s.agent_id == "agent" and s.order()[0] == "a" and s.routes("a") == (("k", "b"), "c") and s.routes("c") == (None, None)
    assert s.checkpoint_of("c") == {"approval_type": "human", "timeout_seconds": 3600, "on_timeout": "reject", "checkpoint_id": "x", "after_task": "b"}
    assert specs.substitute("{{ unknown }}", {}) == "{{ unknown }}"
    (tmp_path / "one.yaml").write_text(SPEC)
    assert specs.Registry.load(str(tmp_path), {"name": "z"}).listed() == [{"agent_id": "z", "description": "d", "tasks": 3, "checkpoint_count": 1}]
    (tmp_path / "two.yml").write_text(SPEC)
    with pytest.raises(specs.SpecError, match="twice"):
        specs.Registry.load(str(tmp_path), {"name": "z"})


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"spec_version": "9"}, "spec_version"), ({"tasks": ["a", "b", "c", "c"]}, "duplicate"), ({"tasks": ["a", "b"]}, "not in tasks"), ({"extra": 1}, "unsupported"), ({"x_extra": 1}, None),
        ({"graph": {"start_task": "q", "tasks": ["a", "b", "c"], "edges": []}}, "start_task"), ({"graph": {"start_task": "a", "tasks": ["a", "b", "c"], "edges": [{"from": "a", "to": "q"}]}}, "unknown tasks"),
        ({"graph": {"start_task": "a", "tasks": ["a", "b", "c"], "edges": [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}]}}, "cycle"),
        ({"graph": {"start_task": "a", "tasks": ["a", "b", "c"], "edges": [{"from": "a", "to": "b", "condition_key": "k"}]}}, "else"),
        ({"checkpoints": [{"checkpoint_id": "x", "after_task": "q"}]}, "unknown task"), ({"react": {"max_iterations": 0}}, "max_iterations"), ({"react": {"stop_conditions": {"confidence_threshold": 1.5}}}, "confidence"),
        ({"policies": {"require_policy_context": True}}, "allowed_collections"), ({"required_tools": ["nope"]}, "unknown tools"), ({"required_tools": ["retrieval.fts"]}, None),
    ],
)
def test_spec_rules(change, said):
    doc = {"agent_id": "i", "description": "d", "spec_version": "1.0", "tasks": ["a", "b", "c"], "graph": {"start_task": "a", "tasks": ["a", "b", "c"], "edges": []}} | change
    found = "; ".join(specs.problems(doc))
    assert (said in found) if said else not found
