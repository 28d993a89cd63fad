"""Heading detection from the text spans of page layouts: page_id, text, font_size, is_bold, x_position, y_position, x_end."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

#: Font size by body size from which on a line is a heading of level 1, 2, 3; bold lines from the last on.
LEVEL_RATIOS, BOLD_RATIO = (2.0, 1.6, 1.2), 1.1
EPSILON = 1e-6


def letters(x: Column | str) -> Column:
    return F.length(F.regexp_replace(col(x), r"\P{IsAlphabetic}+", ""))


def is_bold(weight: Column | str) -> Column:
    return F.coalesce(col(weight) >= 700, F.lit(False))


def usable_spans(spans: DataFrame) -> DataFrame:
    """Spans with text and a font size."""
    size = F.col("font_size").cast("double")
    return spans.where(F.col("text").rlike(r"(?U)\S") & (size > 0) & ~F.isnan(size) & (size < float("inf")))


def body_sizes(spans: DataFrame) -> DataFrame:
    """Each page's body font size: the tenth-of-a-point with most letters (the smaller of equals), if it holds a fifth."""
    weighed = usable_spans(spans).select("page_id", F.round(F.col("font_size").cast("double") * 10).cast("int").alias("bucket"), letters("text").alias("n")).where("n > 0")
    sums = weighed.groupBy("page_id", "bucket").agg(F.sum("n").alias("n"))
    best = sums.groupBy("page_id").agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("bucket"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return best.select("page_id", F.when(F.col("most") >= F.col("all") * 0.2, F.col("bucket") / 10).alias("body_size"))


def is_candidate(x: Column | str) -> Column:
    """3 to 180 characters, three letters and half of it letters, at most 20 words, fewer than three sentence marks."""
    t = col(x)
    n = F.length(t)
    return n.between(3, 180) & (letters(t) >= 3) & (letters(t) * 2 >= n) & (F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")) <= 20) & (F.regexp_count(t, F.lit("[.?!]")) < 3)


def classified(lines: DataFrame) -> DataFrame:
    """Adds ``level`` (null for none) to ``lines(text, font_size, is_bold, body_size)``."""
    ratio = F.col("font_size").cast("double") / F.col("body_size").cast("double")
    level = F.lit(None).cast("int")
    bold = F.col("is_bold") & (ratio >= BOLD_RATIO - EPSILON) & ~F.col("text").rlike("[.?!]")
    level = F.when(bold, 3).otherwise(level)
    for k, least in reversed(list(enumerate(LEVEL_RATIOS, 1))):
        level = F.when(ratio >= least - EPSILON, k).otherwise(level)
    return lines.withColumn("level", F.when(is_candidate("text"), level))


_SPAN = ("text", "font_size", "is_bold", "x_position", "x_end", "y_position")


def _page_lines(spans: list[tuple]) -> Iterator[tuple[str, float, bool]]:
    """One page's spans (text, font_size, is_bold, x_position, x_end, y_position), in order from the top and the left, as
    lines: by height within half the smaller font, then left to right."""
    groups: list[list[tuple]] = []
    low, top = 0, 0.0  # groups before ``low`` are too high for all spans to come
    for s in spans:
        size, y = s[1], s[5]
        while low < len(groups) and groups[low][0][5] - y >= 0.5 * groups[low][0][1]:
            low += 1
        near = next((groups[i] for i in range(low, len(groups)) if abs(y - groups[i][0][5]) < 0.5 * min(size, groups[i][0][1])), None)
        if near is None:
            groups.append([s])
        else:
            near.append(s)
    for g in groups:
        g.sort(key=lambda s: s[3])
        text = [g[0][0]]
        for before, s in zip(g[:-1], g[1:], strict=True):
            text += [" ", s[0]] if s[3] > before[4] and not before[0].endswith("-") and any(text) else [s[0]]
        chars = sum(len(s[0]) for s in g)
        alpha = [sum(map(str.isalpha, s[0])) for s in g]
        strong = sum(a for a, s in zip(alpha, g, strict=True) if s[2])
        yield "".join(text), sum(s[1] * len(s[0]) for s in g) / chars if chars else 0.0, 2 * strong > sum(alpha) > 0


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of pages whose spans come one behind the other."""
    page, spans, pages, out = None, [], [], []

    def rows() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ([],) * 4
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.float64(), pa.bool_()), strict=True)]
        return pa.record_batch([pa.array(pages, kind), *made], names=["page_id", "line", "text", "font_size", "is_bold"])

    def close() -> None:
        found = [(k, *line) for k, line in enumerate(_page_lines(spans))]
        pages.extend([page] * len(found))
        out.extend(found)
        spans.clear()

    for batch in batches:
        kind = batch.schema.field("page_id").type
        for at, *span in zip(*(batch.column(c).to_pylist() for c in ("page_id", *_SPAN)), strict=True):
            if at != page and spans:
                close()
            page = at
            spans.append(tuple(span))
        if out:
            yield rows()
            pages.clear()
            out.clear()
    if spans:
        close()
        yield rows()


def lines(spans: DataFrame) -> DataFrame:
    """Lines of each page: page_id, line, text, font_size (weighted by characters), is_bold (by most letters)."""
    kind = spans.schema["page_id"].dataType.simpleString()
    place = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    at = ("x_position", "x_end", "y_position")
    usable = usable_spans(spans).select("page_id", "text", F.col("font_size").cast("double").alias("font_size"), "is_bold", *map(place, at))
    ordered = usable.repartition("page_id").sortWithinPartitions("page_id", F.desc("y_position"), F.asc_nulls_last("x_position"))
    ordered = ordered.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in at})  # as places that are near none
    return ordered.mapInArrow(_lines_of, f"page_id {kind}, line int, text string, font_size double, is_bold boolean")


def headings(spans: DataFrame) -> DataFrame:
    """The headings of each page in reading order; none for pages without a stable body size."""
    sized = lines(spans).join(body_sizes(spans).where("body_size is not null"), "page_id")
    return classified(sized).where("level is not null").select("page_id", "line", "level", "text")


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{WHITE}]+")


def collapsed(text: str) -> tuple[str, np.ndarray]:
    """The text's words with one space between two, and the place in the text of each of its characters: a space stands
    for the first character of the white space there."""
    words = list(_WORD.finditer(text))
    places = [np.arange(m.start(), m.end() + 1) for m in words]  # each word with the place behind it
    return " ".join([m[0] for m in words]), np.concatenate(places)[:-1] if places else np.zeros(0, np.int64)


def heading_places(page: str, found: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(level, begin, end) of the headings that stand in the page, in order: each is sought behind the one before, whatever
    white space lies between its words, where its white space before begins with a line's end."""
    flat, places = collapsed(page)
    out, at = [], 0
    for level, text in found:
        words, _ = collapsed(text)
        begin = flat.find(words, at) if words else -1
        while begin > 0 and page[places[begin - 1]] not in "\n\r":
            begin = flat.find(words, begin + len(words))
        if begin >= 0:
            at = begin + len(words)
            out.append((level, int(places[begin]), int(places[at]) if at < len(places) else len(page)))
    return out


def marked(page: str, found: list[tuple[int, str]]) -> str:
    """The page text with heading marks put before the headings; what stands in the text stays as it is."""
    out, at = [], 0
    for level, begin, end in heading_places(page, found):
        out += [page[at:begin], "\n", "#" * min(level, 3), " ", page[begin:end], "\n"]
        at = end
    return "".join([*out, page[at:]])


def with_headings(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """``pages(page_id, text)`` with heading marks put in."""
    listed = headings(spans).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line", "level", "text"))).alias("found"))

    @F.pandas_udf("string")
    def mark(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if f is None or t is None else marked(t, [(x["level"], x["text"]) for x in f]) for t, f in zip(text, found, strict=True)])

    return pages.join(listed, "page_id", "left").withColumn("text", mark("text", "found")).drop("found")
