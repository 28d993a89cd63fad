"""Retrieval evaluation: route agreement, evidence recall, coverage, routed against baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .routing import route


def route_agreement(cases: DataFrame) -> DataFrame:
    """``cases(id, query, expected_route, expected_query_class)`` with the route and whether both labels agree."""
    routed = route(cases)
    return routed.select("id", "selected_path", "query_class", ((F.col("selected_path") == F.col("expected_route")) & (F.col("query_class") == F.col("expected_query_class"))).alias("agrees"))


def evidence_recall(cases: DataFrame, found: DataFrame) -> DataFrame:
    """``cases(id, expected_evidence, required_evidence?, min_expected_recall?)`` against ``found(id, document_id)``.

    Wanted are the required documents if there are any, else the expected ones; the least recall defaults to 1.
    """
    listed = found.groupBy("id").agg(F.collect_set("document_id").alias("documents"))
    c = cases
    for name, kind in (("required_evidence", "array<string>"), ("min_expected_recall", "double")):
        c = c if name in c.columns else c.withColumn(name, F.lit(None).cast(kind))
    joined = c.join(listed, "id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))
    wanted = F.col("expected_evidence")
    recall = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, F.col("documents"))) / F.size(wanted)).otherwise(F.lit(1.0))
    needed = F.coalesce("required_evidence", F.array().cast("array<string>"))
    covered = F.size(F.array_except(needed, F.col("documents"))) == 0
    passed = (recall >= F.coalesce(F.col("min_expected_recall").cast("double"), F.lit(1.0))) & covered
    return joined.select("id", recall.alias("recall"), covered.alias("required_found"), passed.alias("passed"))


def compared(routed: DataFrame, baseline: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case the expected documents that routed and baseline retrieval found, and whether routed finds as many."""
    want = expected.select("id", F.explode("expected_evidence").alias("document_id"))
    count = lambda found, name: want.join(found.select("id", "document_id").distinct(), ["id", "document_id"]).groupBy("id").agg(F.count(F.lit(1)).alias(name))
    both = expected.select("id").join(count(routed, "routed_hits"), "id", "left").join(count(baseline, "baseline_hits"), "id", "left").fillna(0, ["routed_hits", "baseline_hits"])
    return both.withColumn("as_good", F.col("routed_hits") >= F.col("baseline_hits"))


def summary(routes: DataFrame, recalls: DataFrame) -> DataFrame:
    """One row: shares of agreeing routes and passing cases, and the mean recall."""
    return routes.join(recalls, "id").agg(F.avg(F.col("agrees").cast("double")).alias("route_agreement"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("recall").alias("mean_recall"), F.count(F.lit(1)).alias("cases"))
