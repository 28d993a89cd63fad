"""Chunking as DataFrame operators: strategy selection, SQL-expressible chunkers, and all strategies in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import packing as P
from ..functions import text as T
from .index import slices, token_windows

#: Names and aliases of the strategies.
ALIASES = {name: name for name in P.STRATEGIES} | {
    "page-aware": "page_tokens", "pageaware": "page_tokens", "characters": "chars", "approx": "chars", "paragraph": "paragraphs", "md": "markdown", "page": "pages", "recursive": "recursive_chars",
}


def strategy_of(name: Column | str) -> Column:
    """The strategy a name or alias stands for, in any case; null if none."""
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.element_at(table, F.lower(T.trim_ws(name)))


def selected_strategy(configured: Column | str, text: Column | str, heading_detection: Column | str | None = None) -> Column:
    """The configured strategy if it is one; else markdown for texts with headings, tokens for others."""
    mode = F.lower(F.trim(T.col(heading_detection))) if heading_detection is not None else F.lit(None).cast("string")
    on = ~F.coalesce(mode.isin("off", "false", "disabled", "0"), F.lit(False))
    headings = T.col(text).rlike(r"(?m)^\s*#{1,6} ")
    return F.coalesce(strategy_of(configured), F.when(on & headings, F.lit("markdown")).otherwise(F.lit("tokens")))


def word_start(text: Column | str) -> Column:
    """Drop a leading word in lower case, unless it is all there is."""
    left = F.regexp_replace(T.col(text), r"(?U)^\s+", "")
    return F.regexp_replace(left, r"(?U)^\p{Ll}\S*\s+", "")


def normalised_starts(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks with their starts normalised; those that become empty are dropped."""
    return chunks.withColumn(text, word_start(text)).where(F.length(text) > 0)


def token_chunks(docs: DataFrame, size: int, overlap: float, *keep: str) -> DataFrame:
    """Windows of space-separated tokens: keep columns, chunk_index, text, n_tokens."""
    split = docs.select(*keep, T.words("text").alias("words"))  # a column of its own, so that no window splits again
    rows = split.select(*keep, F.posexplode(token_windows(F.col("words"), size, overlap)).alias("chunk_index", "w"))
    return rows.select(*keep, "chunk_index", F.array_join("w", " ").alias("text"), F.size("w").alias("n_tokens"))


def page_chunks(docs: DataFrame, size: int, overlap: float, *keep: str, numbered: bool = False) -> DataFrame:
    """Pages of ``text`` in labelled windows of space-separated tokens (a label costs its own tokens)."""
    pages = docs.select(*keep, F.posexplode(F.split("text", "\f")).alias("page", "body")).withColumn("page", F.col("page") + 1).where(F.length(T.trim_ws("body")) > 0)
    room = max(1, size - (4 if numbered else 2))
    split = pages.select(*keep, "page", T.words(T.trim_ws("body")).alias("words"))
    rows = split.select(*keep, "page", F.posexplode(token_windows(F.col("words"), room, overlap)).alias("k", "w"))
    number = F.concat(F.lit(" chunk "), (F.col("k") + 1).cast("string")) if numbered else F.lit("")
    label = F.concat(F.lit("[page "), F.col("page").cast("string"), number, F.lit("]\n"))
    return rows.select(*keep, "page", (F.col("k") + 1).alias("chunk"), F.concat(label, F.array_join("w", " ")).alias("text"))


def markdown_sections(docs: DataFrame, key: str) -> DataFrame:
    """Parts of ``docs(key, text)`` between headings: key, section, title, path, level, text; by windows over lines."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("at", "line"))
    marks = F.regexp_extract("line", r"(?U)^\s*(#{1,6})\s+\S", 1)
    title = T.trim_ws(F.regexp_extract("line", r"(?U)^\s*#{1,6}\s+(\S.*)$", 1))
    lines = lines.withColumn("level", F.nullif(F.length(marks), F.lit(0))).withColumn("title", F.when(F.col("level").isNotNull(), title))
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count("level").over(order))
    grouped = lines.groupBy(key, "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"), F.max("title").alias("title"), F.max("level").alias("level"))
    # A heading of level v is on the path of a later section if no heading in between has a level of v or less: of each
    # level the last heading counts, if it stands behind the last ones of all lower levels.
    earlier = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda v: F.max(F.when(F.col("level") == v, F.struct("section", "title"))).over(earlier)
    seen = grouped.select("*", *(last(v).alias(f"h{v}") for v in range(1, 7)))
    on_path = [F.when((F.col(f"h{v}.section") >= F.greatest(*(F.coalesce(f"h{u}.section", F.lit(0)) for u in range(1, v)), F.lit(0), F.lit(0))) & (F.col("level") >= v), F.col(f"h{v}.title")) for v in range(1, 7)]
    path = F.when(F.col("level").isNotNull(), F.array_join(F.array_compact(F.array(*on_path)), " > "))
    return seen.select(key, "section", "title", path.alias("path"), "level", T.trim_ws("text").alias("text")).where(F.length("text") > 0)


#: Bytes of text whose chunks are held at once.
SLICE_BYTES = 1 << 20
_SECTION = "text string, section_title string, section_path string, heading_level int"


def _tokens(kind: str, path: str | None) -> P.Tokens:
    if kind == "words":
        return P.word_tokens()
    return P.byte_pair_tokens(path) if kind == "byte_pairs" else P.Tokens()


def chunked(docs: DataFrame, size: int = 600, overlap: float = 0.15, tokenizer: str = "bytes", vocabulary: str | None = None, semantic=None, keep: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """All strategies: ``docs(keep..., text, strategy)`` to keep, chunk_index, text and section columns.

    ``tokenizer`` is ``bytes`` (four bytes a token), ``words`` or ``byte_pairs`` with a vocabulary file.  Rows may
    carry ``max_tokens`` and ``overlap_ratio`` of their own.  Null texts have no chunks.
    """
    names = list(dict.fromkeys([*keep, "text", "strategy", "max_tokens", "overlap_ratio"]))
    have = docs.columns
    rows = docs
    for c, value, kind in (("max_tokens", size, "int"), ("overlap_ratio", overlap, "double")):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(value)).cast(kind) if c in have else F.lit(value).cast(kind))
    rows = rows.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer, vocabulary)
        for batch in (part for whole in batches for part in slices(whole, SLICE_BYTES)):
            take, out = [], []
            for i, x in enumerate(batch.select(["text", "strategy", "max_tokens", "overlap_ratio"]).to_pylist()):
                if x["text"] is None:
                    continue
                found = P.chunk(x["text"], x["strategy"] or "tokens", x["max_tokens"], x["overlap_ratio"], tokens, semantic)
                take += [i] * len(found)
                out += [(k, c, s.title, s.path, s.level) for k, (c, s) in enumerate(found)]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)]
                yield pa.record_batch([*(batch.column(c).take(pa.array(take)) for c in keep), *columns], names=[*keep, "chunk_index", "text", "section_title", "section_path", "heading_level"])

    return rows.mapInArrow(run, f"{schema}, chunk_index int, {_SECTION}")
