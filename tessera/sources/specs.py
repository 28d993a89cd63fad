"""Agent specs from YAML: placeholders, defaults, and all rules; graphs of tasks with conditional edges."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

try:
    import yaml
except ImportError:  # only reading YAML needs it
    yaml = None

VERSIONS = ("1.0",)
TOOLS = {"retrieval.dense", "retrieval.sparse", "retrieval.hybrid", "retrieval.fts", "retrieval.expand_chunk_neighbors", "retrieval.fetch_document", "sql_allowlist"}
BLOCKS = {"agent_id", "description", "spec_version", "tasks", "graph", "checkpoints", "context", "retrieval", "guardrails", "policies", "react", "required_tools"}
#: Fixed default values.
REACT = {"enabled": False, "max_iterations": 5, "max_history": 20, "trace_reasoning": True, "action_types": ["search", "refine_query", "conclude"]}
STOP = {"confidence_threshold": 0.85, "max_actions": 10, "explicit_stop": True}
CHECKPOINT = {"approval_type": "human", "timeout_seconds": 3600, "on_timeout": "reject"}
_PLACE = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")


class SpecError(ValueError):
    """What a spec gets wrong."""


def substitute(value, known: dict[str, str]):
    """Replace ``{{ name }}`` in all strings of a document; unknown names stay."""
    if isinstance(value, str):
        return _PLACE.sub(lambda m: str(known.get(m[1], m[0])), value)
    if isinstance(value, list):
        return [substitute(x, known) for x in value]
    if isinstance(value, dict):
        return {k: substitute(x, known) for k, x in value.items()}
    return value


@dataclass(frozen=True)
class Spec:
    agent_id: str
    description: str
    version: str
    tasks: tuple[str, ...]
    start: str
    edges: tuple[tuple[str, str, str | None], ...]
    checkpoints: tuple[dict, ...] = ()
    react: dict | None = None
    policies: dict | None = None
    required_tools: tuple[str, ...] = ()
    blocks: dict = field(default_factory=dict)

    def predecessors(self, task: str) -> list[str]:
        return [a for a, b, _ in self.edges if b == task]

    def checkpoint_of(self, task: str) -> dict | None:
        """The checkpoint whose ``after_task`` stands right before a task."""
        before = self.predecessors(task)
        return next((c for c in self.checkpoints if c["after_task"] in before), None)

    def order(self) -> list[str]:
        """Tasks so that each follows all that lead to it."""
        graph = {t: set(self.predecessors(t)) for t in self.tasks}
        return list(TopologicalSorter(graph).static_order())

    def routes(self, task: str) -> tuple[tuple[str, str] | None, str | None]:
        """The conditional edge (key, target) and the unconditional target of a task."""
        out = [(b, key) for a, b, key in self.edges if a == task]
        return next(((key, b) for b, key in out if key), None), next((b for b, key in out if not key), None)


def _repeated(names: list[str]) -> list[str]:
    return sorted({n for n in names if names.count(n) > 1})


def problems(doc: dict, tools: set[str] = TOOLS) -> list[str]:
    """Every rule that a spec document breaks, in the order of the rules."""
    out: list[str] = []
    if missing := sorted(k for k in ("agent_id", "description", "spec_version", "tasks", "graph") if k not in doc):
        return [f"missing fields: {', '.join(missing)}"]
    if extra := sorted(k for k in doc if k not in BLOCKS and not k.startswith("x_")):
        out.append(f"unsupported top-level fields: {', '.join(extra)} (only x_* are allowed)")
    if doc["spec_version"] not in VERSIONS:
        out.append(f"unsupported spec_version {doc['spec_version']!r} (supported: {', '.join(VERSIONS)})")
    graph, tasks = doc["graph"], doc["tasks"]
    nodes, edges = graph["tasks"], graph.get("edges", [])
    for label, names in (("tasks", tasks), ("graph.tasks", nodes)):
        if twice := _repeated(names):
            out.append(f"duplicate entries in {label}: {', '.join(twice)}")
    if graph["start_task"] not in nodes:
        out.append(f"start_task {graph['start_task']!r} is not in graph.tasks")
    if strange := sorted({x for e in edges for x in (e["from"], e["to"])} - set(nodes)):
        out.append(f"graph edges reference unknown tasks: {', '.join(strange)}")
    if only := sorted(set(tasks) - set(nodes)):
        out.append(f"tasks that are not in graph.tasks: {', '.join(only)}")
    if only := sorted(set(nodes) - set(tasks)):
        out.append(f"graph.tasks that are not in tasks: {', '.join(only)}")
    for source in dict.fromkeys(e["from"] for e in edges):
        keys = [e.get("condition_key") for e in edges if e["from"] == source]
        if sum(k is not None for k in keys) > 1:
            out.append(f"task {source!r} has several conditional edges; one is supported")
        elif any(keys) and None not in keys:
            out.append(f"task {source!r} has a conditional edge but no unconditional one as its else path")
    try:
        TopologicalSorter({n: {e["from"] for e in edges if e["to"] == n} for n in nodes}).prepare()
    except CycleError as e:
        out.append(f"the graph contains a cycle: {' -> '.join(e.args[1])}")
    points = doc.get("checkpoints") or []
    if twice := _repeated([c["checkpoint_id"] for c in points]):
        out.append(f"duplicate checkpoint_id: {', '.join(twice)}")
    if twice := _repeated([c["after_task"] for c in points]):
        out.append(f"several checkpoints after one task: {', '.join(twice)}")
    for c in points:
        if c["after_task"] not in nodes:
            out.append(f"checkpoint {c['checkpoint_id']!r} references unknown task {c['after_task']!r}")
    if doc.get("react") is not None:
        react = REACT | doc["react"]
        stop = STOP | (react.get("stop_conditions") or {})
        if not 0 <= stop["confidence_threshold"] <= 1:
            out.append("react.stop_conditions.confidence_threshold must be from 0 to 1")
        if react["max_iterations"] <= 0:
            out.append("react.max_iterations must be > 0")
        if not react["action_types"]:
            out.append("react.action_types must not be empty")
    policies = doc.get("policies") or {}
    if policies.get("require_policy_context") and not policies.get("allowed_collections"):
        out.append("policies.require_policy_context needs allowed_collections")
    if strange := sorted(set(doc.get("required_tools") or []) - tools):
        out.append(f"unknown tools: {', '.join(strange)}")
    return out


def spec_of(doc: dict, tools: set[str] = TOOLS) -> Spec:
    """The spec of a document, with defaults filled in; an error lists what is wrong."""
    if found := problems(doc, tools):
        raise SpecError("; ".join(found))
    graph = doc["graph"]
    react = None
    if doc.get("react") is not None:
        react = REACT | doc["react"]
        react["stop_conditions"] = STOP | (react.get("stop_conditions") or {})
    return Spec(
        doc["agent_id"], doc["description"].strip(), doc["spec_version"], tuple(graph["tasks"]), graph["start_task"], tuple((e["from"], e["to"], e.get("condition_key")) for e in graph.get("edges", [])),
        tuple(CHECKPOINT | c for c in doc.get("checkpoints") or []), react, doc.get("policies"), tuple(doc.get("required_tools") or ()), {k: v for k, v in doc.items() if k in ("context", "retrieval", "guardrails") or k.startswith("x_")},
    )


def read_spec(text: str, known: dict[str, str] | None = None, tools: set[str] = TOOLS) -> Spec:
    if yaml is None:
        raise ImportError("reading agent specs needs PyYAML")
    return spec_of(substitute(yaml.safe_load(text), known or {}), tools)


class Registry:
    """Specs by agent_id."""

    def __init__(self, specs: list[Spec] = ()):
        self.specs: dict[str, Spec] = {}
        for s in specs:
            self.add(s)

    def add(self, spec: Spec) -> None:
        if spec.agent_id in self.specs:
            raise SpecError(f"agent_id {spec.agent_id!r} is registered twice")
        self.specs[spec.agent_id] = spec

    @classmethod
    def load(cls, folder: str, known: dict[str, str] | None = None) -> Registry:
        """Every .yaml or .yml file of a folder, by name."""
        files = sorted(p for p in Path(folder).iterdir() if p.is_file() and p.suffix in (".yaml", ".yml"))
        return cls([read_spec(p.read_text(), known) for p in files])

    def listed(self) -> list[dict]:
        return [{"agent_id": s.agent_id, "description": s.description, "tasks": len(s.tasks), "checkpoint_count": len(s.checkpoints)} for _, s in sorted(self.specs.items())]


#: The two graphs the engine ships.
ROUTED = Spec("routed_search", "Routes a query to a single-pass answer or to evidence first.", "1.0", ("route_query", "baseline_answer", "retrieve_evidence", "compose_answer", "final_answer"), "route_query",
              (("route_query", "retrieve_evidence", "route_to_agentic_search"), ("route_query", "baseline_answer", None), ("retrieve_evidence", "compose_answer", None), ("baseline_answer", "final_answer", None), ("compose_answer", "final_answer", None)))
APPROVED = Spec("approved_answer", "Classifies, searches and sums up, waits for approval, then answers.", "1.0", ("classify", "hybrid_search", "summarize", "approval_checkpoint", "final_answer"), "classify",
                (("classify", "hybrid_search", None), ("hybrid_search", "summarize", None), ("summarize", "approval_checkpoint", None), ("approval_checkpoint", "final_answer", None)),
                (CHECKPOINT | {"checkpoint_id": "post_summary", "after_task": "summarize", "timeout_seconds": 1800},))
