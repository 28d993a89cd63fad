"""Conversations: history, merging of turns, resolution, prompts and answers through a model port."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import context as C

SYSTEM_TEMPLATE = "Answer from the context alone and cite its numbers.\n{{language_instruction}}\n\nContext:\n{{{context}}}\n"
ANALYST_PROMPT = "You are a careful analyst. Sum up what the numbered passages say about the question, and cite them."


def latest_messages(messages: DataFrame, limit: int, conversation: str = "conversation_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The last ``limit`` messages of each conversation, with ``position`` in rising order."""
    if limit <= 0:
        raise ValueError("the limit must be greater than zero")
    newest = Window.partitionBy(conversation).orderBy(*(F.desc(c) for c in order))
    kept = messages.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= limit)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(conversation).orderBy(*order))).drop("age")


def model_history(messages: DataFrame, limit: int, **kwargs) -> DataFrame:
    """What the model sees: the limit counts system messages, which are dropped afterwards."""
    return latest_messages(messages, limit, **kwargs).where("role != 'system'")


def coalesced(messages: DataFrame, conversation: str = "conversation_id", order: str = "position", content: str = "content") -> DataFrame:
    """Consecutive messages of one role as one, joined by line breaks: conversation, turn, role, content."""
    w = Window.partitionBy(conversation).orderBy(order)
    changed = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)
    islands = messages.withColumn("changed", changed).withColumn("turn", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, content))), lambda m: m[content])
    return islands.groupBy(conversation, "turn", "role").agg(F.array_join(lines, "\n").alias(content))


def owned(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages whose conversation belongs to their tenant."""
    return messages.join(conversations.select("tenant", F.col("id").alias("conversation_id")), ["tenant", "conversation_id"], "left_semi")


def resolved(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """Each request's conversation and collection, or an ``error``.

    A resumed conversation must exist in the tenant, and its collection must be the requested one if both are given; a
    new conversation needs a collection.
    """
    known = conversations.select("tenant", F.col("id").alias("conversation_id"), F.col("collection").alias("stored"), F.lit(True).alias("found"))
    r = requests.join(known, ["tenant", "conversation_id"], "left")
    resumes = F.col("conversation_id").isNotNull()
    wanted = T.non_blank("collection")
    collection = F.when(resumes, F.coalesce("stored", wanted)).otherwise(wanted)
    error = (
        F.when(resumes & F.col("found").isNull(), "conversation not found")
        .when(resumes & wanted.isNotNull() & F.col("stored").isNotNull() & (wanted != F.col("stored")), "collection does not match the conversation")
        .when(collection.isNull(), "collection is required")
    )
    return r.select(*requests.columns, collection.alias("resolved_collection"), error.alias("error"), (~resumes).alias("is_new"))


def system_prompt(context: Column | str, language: Column | str | None = None, template: str = SYSTEM_TEMPLATE) -> Column:
    """The system prompt around a rendered context; a language adds an instruction."""
    told = F.lit(None).cast("string") if language is None else T.col(language)
    instruction = F.coalesce(F.concat(F.lit("Answer in "), told, F.lit(".")), F.lit(""))
    return T.render_template(template, context=T.col(context), language_instruction=instruction)


Model = Callable[[list[list[dict[str, str]]]], list[str]]


def mock_model(conversations: list[list[dict[str, str]]]) -> list[str]:
    """Answers with a fixed sentence around the last user message."""
    return [f"Mock answer to: {next((m['content'] for m in reversed(c) if m['role'] == 'user'), '')}" for c in conversations]


def answer(prompts: DataFrame, model: Model = mock_model, messages: str = "messages") -> DataFrame:
    """Adds ``answer`` by a model port that takes batches of message lists (role, content)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema), "answer string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = [[dict(m.asDict() if hasattr(m, "asDict") else m) for m in row] for row in batch[messages]]
            yield batch.assign(answer=model(asked))

    return prompts.mapInPandas(run, schema)


def single_shot(queries: DataFrame, hits: DataFrame, model: Model = mock_model, **budget) -> DataFrame:
    """Retrieval answers: fused hits to context (one chunk a document, cited), prompt, model; with sources.

    Queries without hits get an empty context.
    """
    context = C.rendered(C.build(hits, strategy="document", **budget))
    joined = queries.join(context, "query_id", "left")
    prompt = system_prompt(F.coalesce("context", F.lit("")))
    said = F.array(F.struct(F.lit("system").alias("role"), prompt.alias("content")), F.struct(F.lit("user").alias("role"), F.col("query").alias("content")))
    return answer(joined.withColumn("messages", said), model).drop("messages")


def summarised(queries: DataFrame, hits: DataFrame, model: Model = mock_model, **budget) -> DataFrame:
    """A summary of given hits: deduped by chunk, without citations, under a fixed prompt; no new retrieval."""
    context = C.rendered(C.build(hits, strategy="chunk", citations=False, **budget))
    said = F.array(F.struct(F.lit("system").alias("role"), F.lit(ANALYST_PROMPT).alias("content")), F.struct(F.lit("user").alias("role"), F.concat_ws("\n\n", "query", "context").alias("content")))
    return answer(queries.join(context, "query_id", "left").withColumn("messages", said), model).drop("messages")


def turn_pairs(answers: DataFrame) -> DataFrame:
    """The rows to append after a successful answer: the user's message and the assistant's, in one write."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    rows = answers.where("answer is not null").select("tenant", "conversation_id", F.posexplode(pair).alias("part", "m"))
    return rows.select("tenant", "conversation_id", "part", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
