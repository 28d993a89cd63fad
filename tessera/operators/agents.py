"""Agent graphs over many runs at once: every task is a DataFrame function over the runs that reach it.

A conditional edge splits the runs by a boolean column; joins of branches are unions.  Steps are counted, so a run that
would need more than its limit ends as failed; a checkpoint pauses the runs without a decision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.specs import Spec
from . import chat, routing

Task = Callable[[DataFrame], DataFrame]
NO_EVIDENCE = "No evidence was found for this question."


def route_query(runs: DataFrame) -> DataFrame:
    return routing.route(runs).withColumn("route_to_agentic_search", F.col("selected_path") == "agentic_search")


def classify(runs: DataFrame) -> DataFrame:
    return runs.withColumn("query_type", routing.query_type("query"))


def final_answer(runs: DataFrame) -> DataFrame:
    said = [F.col(c) for c in ("answer", "summary") if c in runs.columns]
    text = F.coalesce(*said, F.lit(NO_EVIDENCE))
    if "decision" in runs.columns:
        reason = F.coalesce("reason", F.lit("no reason given")) if "reason" in runs.columns else F.lit("no reason given")
        text = F.when(F.col("decision") == "reject", F.concat(F.lit("Rejected: "), reason)).otherwise(text)
    return runs.withColumn("final_answer", text)


def approval_checkpoint(spec: Spec, task: str = "approval_checkpoint") -> Task:
    point = spec.checkpoint_of(task) or {}

    def run(runs: DataFrame) -> DataFrame:
        decided = runs if "decision" in runs.columns else runs.withColumn("decision", F.lit(None).cast("string"))
        asked = F.struct(*(F.lit(str(point.get(k, ""))).alias(k) for k in ("checkpoint_id", "approval_type", "timeout_seconds", "on_timeout")))
        return decided.withColumn("pending", F.when(F.col("decision").isNull(), asked)).withColumn("paused", F.col("decision").isNull())

    return run


def retrieval_tasks(hits: DataFrame, model: chat.Model = chat.mock_model, baseline: DataFrame | None = None) -> dict[str, Task]:
    """The tasks that use retrieval results, given fused ``hits(query_id, ...)`` of the runs' queries."""
    kept = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "document_id"))).alias("search_results"))

    def retrieve(runs: DataFrame) -> DataFrame:
        return runs.join(kept, "query_id", "left")

    def compose(runs: DataFrame) -> DataFrame:
        told = chat.summarised(runs.select("query_id", "query"), hits, model).select("query_id", F.when(F.col("context").isNotNull(), F.col("answer")).otherwise(F.lit(NO_EVIDENCE)).alias("answer"))
        return runs.join(told, "query_id", "left")

    def single(runs: DataFrame) -> DataFrame:
        told = chat.single_shot(runs.select("query_id", "query"), hits if baseline is None else baseline, model).select("query_id", "answer")
        return runs.join(told, "query_id", "left")

    def summarize(runs: DataFrame) -> DataFrame:
        return compose(runs).withColumnRenamed("answer", "summary")

    return {"retrieve_evidence": retrieve, "hybrid_search": retrieve, "compose_answer": compose, "baseline_answer": single, "summarize": summarize}


def execute(spec: Spec, runs: DataFrame, tasks: dict[str, Task], max_steps: int = 20) -> DataFrame:
    """Run a graph for ``runs(run_id, query_id, query, ...)``: adds ``status`` (completed, waiting, failed) and ``steps``."""
    own: dict[str, Task] = {"route_query": route_query, "classify": classify, "final_answer": final_answer, "approval_checkpoint": approval_checkpoint(spec)}
    known = own | tasks
    if strange := sorted(set(spec.tasks) - known.keys()):
        raise ValueError(f"no implementation of: {', '.join(strange)}")
    waiting: dict[str, list[DataFrame]] = {spec.start: [runs.withColumn("steps", F.array().cast("array<string>"))]}
    done: list[DataFrame] = []

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    for task in spec.order():
        if task not in waiting:
            continue
        here = union(waiting.pop(task))
        spent = F.size("steps") >= max_steps
        done.append(here.where(spent).withColumn("status", F.lit("failed")))
        after = known[task](here.where(~spent)).withColumn("steps", F.concat("steps", F.array(F.lit(task))))
        if "paused" in after.columns:
            done.append(after.where("paused").withColumn("status", F.lit("waiting")).drop("paused"))
            after = after.where("not paused").drop("paused")
        condition, otherwise = spec.routes(task)
        if condition:
            key, target = condition
            flag = F.coalesce(F.col(key), F.lit(False)) if key in after.columns else F.lit(False)
            waiting.setdefault(target, []).append(after.where(flag))
            after = after.where(~flag)
        if otherwise:
            waiting.setdefault(otherwise, []).append(after)
        else:
            done.append(after.withColumn("status", F.lit("completed")))
    return union(done)


def step_records(results: DataFrame) -> DataFrame:
    return results.select("run_id", F.posexplode("steps").alias("step", "task"))


def runs_of(runs: DataFrame, tenant: str, agent: str | None = None) -> DataFrame:
    """A tenant's runs (of one agent, if given) by run_id; other tenants' runs are as good as unknown."""
    own = runs.where(F.col("tenant") == tenant)
    return (own if agent is None else own.where(F.col("agent_id") == agent)).orderBy("run_id")


def decided(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Waiting runs with the decision their own tenant made: ready to be executed again from the checkpoint."""
    return runs.where("status = 'waiting'").drop("decision", "reason", "pending", "status").join(decisions.select("run_id", "tenant", "decision", "reason"), ["run_id", "tenant"])
