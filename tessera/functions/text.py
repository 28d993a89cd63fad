"""Scalar text functions as Column expressions: trimming, tokens, counts, ids and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of object identifiers for name-based UUIDs (RFC 4122).
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"
CHARS_PER_TOKEN = 4
#: Sentence ends: ASCII, ideographic and full-width, Arabic question mark, danda.
SENTENCE_ENDS = ".!?。！？؟।"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: Column | str) -> Column:
    """Trim all Unicode white space (``trim`` takes only spaces)."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def collapse_ws(x: Column | str) -> Column:
    """Every run of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def non_blank(x: Column | str) -> Column:
    """The value, or null if it is blank."""
    return F.when(F.length(trim_ws(x)) > 0, col(x))


def empty_to_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


def terms(x: Column | str) -> Column:
    """Lower-cased runs of letters and digits: the tokens of BM25 and of full-text search."""
    return F.array_remove(F.split(F.lower(col(x)), r"[^\p{L}\p{N}]+"), "")


def words(x: Column | str) -> Column:
    """What stands between single spaces."""
    return F.array_remove(F.split(col(x), " "), "")


def token_estimate(x: Column | str) -> Column:
    """Tokens estimated from UTF-8 bytes, four to a token, rounded up."""
    return F.ceil(F.octet_length(col(x)) / F.lit(CHARS_PER_TOKEN)).cast("long")


def checksum(x: Column | str) -> Column:
    return F.sha2(F.encode(col(x), "UTF-8"), 256)


def uuid5(name: Column | str, namespace: str = OID_NAMESPACE) -> Column:
    """The name-based (SHA-1) UUID of a string, in expressions only."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(col(name), "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.lower(F.hex(nibble)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_uuid(tenant: Column | str, document: Column | str, index: Column | str) -> Column:
    """The stable id of a chunk: the UUID of ``tenant:document:index``."""
    return uuid5(F.concat_ws(":", col(tenant), col(document).cast("string"), col(index).cast("string")))


def preview(x: Column | str, size: int = 80) -> Column:
    return F.substring(col(x), 1, size)


def format_score(x: Column | str) -> Column:
    return F.format_string("%.2f", col(x).cast("double"))


def valid_tenant(x: Column | str) -> Column:
    """1 to 128 of letters, digits, underscore and hyphen."""
    return F.coalesce(col(x).rlike(r"^[A-Za-z0-9_-]{1,128}\z"), F.lit(False))


def is_cjk_count(x: Column | str) -> Column:
    return F.regexp_count(col(x), F.lit(r"[一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ]"))


def script_budget(x: Column | str, budget: int, factor: float = 1.5) -> Column:
    """The token budget, enlarged for texts whose letters are mostly Chinese or Japanese."""
    cjk, letters = is_cjk_count(x), F.regexp_count(col(x), F.lit(r"\p{IsAlphabetic}"))
    return F.when((letters > 0) & (cjk / letters > 0.5) & (F.lit(factor) > 1), F.floor(F.lit(budget * factor)).cast("int")).otherwise(F.lit(budget))


def render_template(template: str, **values: Column) -> Column:
    """Replace ``{{{name}}}`` by a value as it is and ``{{name}}`` by it HTML-escaped; unknown names are an error."""
    import re

    names = set(re.findall(r"\{\{\{?\s*(\w+)\s*\}?\}\}", template))
    if names - values.keys():
        raise KeyError(f"unknown names in the template: {sorted(names - values.keys())}")
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{\{\s*(\w+)\s*\}\}\}|\{\{\s*(\w+)\s*\}\}", template):
        parts.append(F.lit(template[at : m.start()]))
        value = F.coalesce(values[m[1] or m[2]], F.lit(""))
        if m[2]:
            for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
                value = F.replace(value, F.lit(raw), F.lit(safe))
        parts.append(value)
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
