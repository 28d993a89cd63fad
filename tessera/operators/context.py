"""Context assembly: order, dedupe, greedy budget, citations, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

MAX_TOKENS, MAX_CHUNKS = 8000, 50
DEDUPE = {"document": ("document_id",), "chunk": ("chunk_id",), "none": ()}


def deduped(hits: DataFrame, strategy: str = "document") -> DataFrame:
    """Of each query's hits with one document (or chunk) the best by (fused_score, chunk_id)."""
    if strategy not in DEDUPE:
        raise ValueError(f"unknown dedupe strategy {strategy!r}")
    if not DEDUPE[strategy]:
        return hits
    window = Window.partitionBy("query_id", *DEDUPE[strategy]).orderBy(F.desc("fused_score"), "chunk_id")
    return hits.withColumn("place", F.row_number().over(window)).where("place = 1").drop("place")


def _greedy(items: Column, max_tokens: int, max_chunks: int) -> Column:
    """The items taken in order: one that does not fit is skipped, and later ones may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        fits = (F.size(s["taken"]) < max_chunks) & (s["used"] + x["tokens"] <= max_tokens)
        return F.struct(F.when(fits, s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["taken"], F.array(x["ordinal"]))).otherwise(s["taken"]).alias("taken"))

    return F.aggregate(items, start, step, lambda s: s["taken"])


def build(hits: DataFrame, max_tokens: int = MAX_TOKENS, max_chunks: int = MAX_CHUNKS, strategy: str = "document", citations: bool = True, tokens: Column | None = None) -> DataFrame:
    """One row a query: ``chunks`` in order (with token counts and citations), ``citations`` and ``stats``.

    ``hits`` are fused hits; a query's hits are at most its retrieval limits, so they fit in one row.
    """
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("input_count"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "chunk_id")
    rows = deduped(hits, strategy).withColumn("ordinal", F.row_number().over(order)).withColumn("tokens", T.token_estimate("text") if tokens is None else tokens)
    sources = F.col("sources") if "sources" in hits.columns else F.array().cast("array<string>")
    item = F.struct("ordinal", "tokens", "chunk_id", "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text", "fused_score", sources.alias("sources"))
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kept = listed.withColumn("taken", _greedy(F.col("items"), max_tokens, max_chunks)).withColumn("kept", F.filter("items", lambda x: F.array_contains("taken", x["ordinal"])))
    cited = lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["document_id"].alias("document_id"), x["chunk_index"].alias("chunk_index"), x["sources"].alias("sources"))
    cites = F.transform("kept", cited) if citations else F.filter(F.transform("kept", cited), lambda _: F.lit(False))
    stats = F.struct(
        F.col("input_count"), F.size("items").alias("after_dedupe"), F.size("kept").alias("final_count"),
        (F.col("input_count") - F.size("items")).alias("dedupe_dropped"), (F.size("items") - F.size("kept")).alias("budget_dropped"),
    )
    return kept.join(counted, "query_id").select("query_id", F.col("kept").alias("chunks"), cites.alias("citations"), stats.alias("stats"))


def rendered(context: DataFrame) -> DataFrame:
    """Adds ``context``: the chunks as ``[i] text``, counted from 1, with rules between them."""
    lines = F.transform("chunks", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"]))
    return context.withColumn("context", F.array_join(lines, "\n---\n"))


def evidence(context: DataFrame, hits: DataFrame) -> DataFrame:
    """The retrieval rows of the chunks that survived, in context order."""
    kept = context.select("query_id", F.posexplode("chunks").alias("position", "c")).select("query_id", "position", F.col("c.chunk_id").alias("chunk_id"))
    return kept.join(hits, ["query_id", "chunk_id"])
