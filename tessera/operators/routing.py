"""Query routing and classification as Column expressions over keyword families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

#: Fixed keyword families of the router, matched as substrings of the lower-cased query.
COMPARE = ("compare ", "tradeoff", "vs ")
HOW_TO = ("how do i", "runbook", "steps")
AMBIGUITY = ("which ", "difference between")
EXPLORATORY = ("find ", "show me", "search for", "overview of", "documents about", "docs about")
TIME = ("today", "latest", "current")
#: Fixed keyword families of the structured / semantic classifier.
STRUCTURED = ("select ", "where ", " from ", "count of", "show me all", "how many", "list all", "group by", "order by")
SEMANTIC = ("what is", "what are", "explain", "describe", "how does", "how do", "why ", "about ", "tell me", "summarize", "overview")

#: In order of precedence: family, its reason, query class, retrieval profile.
ROUTES = ((COMPARE, "compare", "multi_hop_research", "broad_then_expand"), (HOW_TO, "procedural", "procedural", "lexical_first"), (AMBIGUITY, "ambiguity", "ambiguity_disambiguation", "lexical_first"), (EXPLORATORY, "exploratory", "exploratory_search", "broad_then_expand"))


def any_of(x: Column, family: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in family:
        found = found | x.contains(word)
    return found


def _first(hits: list[Column], values: list[str], default: str) -> Column:
    out = F.lit(default)
    for hit, value in reversed(list(zip(hits, values, strict=True))):
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def route(queries: DataFrame, query: str = "query") -> DataFrame:
    """Adds the route decision of each query: the first family that matches decides, all that match are reasons."""
    lower = F.lower(query)
    hits = [any_of(lower, family) for family, *_ in ROUTES]
    agentic = hits[0] | hits[1] | hits[2] | hits[3]
    time = any_of(lower, TIME)
    reasons = F.array_compact(F.array(*(F.when(h, F.lit(r[1])) for h, r in zip(hits, ROUTES, strict=True)), F.when(~agentic, F.lit("default")), F.when(time, F.lit("time_sensitive"))))
    return queries.select(
        "*", F.when(agentic, F.lit("agentic_search")).otherwise(F.lit("single_pass_rag")).alias("selected_path"), _first(hits, [r[2] for r in ROUTES], "simple_fact").alias("query_class"),
        _first(hits, [r[3] for r in ROUTES], "simple_hybrid").alias("retrieval_profile"), hits[2].alias("ambiguity"), hits[0].alias("needs_multi_hop"), (hits[0] | hits[1] | hits[3]).alias("needs_high_evidence"), time.alias("time_sensitive"), reasons.alias("reasons"),
    )


def query_type(query: Column | str) -> Column:
    """structured, unstructured or mixed, by SQL phrases and comparison signs against question words."""
    lower = F.lower(col(query))
    structured = any_of(lower, STRUCTURED) | lower.rlike("[=<>]")
    return F.when(structured & any_of(lower, SEMANTIC), "mixed").when(structured, "structured").otherwise("unstructured")
