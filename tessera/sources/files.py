"""Documents and their sidecars from folders, read by Spark."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .extract import Extractors

#: File types by extension.
EXTENSIONS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text"}
SIDECAR = ".metadata.json"
#: Fields of a sidecar, as a Spark schema.
SIDECAR_SCHEMA = """
schema_version int,
document struct<id:string,title:string,category:string,version:string,authors:array<string>,summary:string,published_at:string,refresh_cadence:string,content_owner:string,last_updated:string>,
source struct<url:string,domain:string,publisher:string,collection:string>,
language string, tags array<string>,
acl struct<allow_roles:array<string>,deny_roles:array<string>,notes:string>,
security struct<classification:string,requires_evidence_pack:boolean,compartments:array<string>,contains_pii:boolean,export_control:string>,
provenance struct<retrieved_at:string,retrieved_by:string,checksum_sha256:string>,
ingestion struct<collection:string,chunking:struct<strategy:string,max_tokens:int,overlap_ratio:double>,ocr:struct<force:boolean,language_hints:array<string>,timeout_secs:bigint>>
"""


def file_type(extension: Column | str) -> Column:
    """The type an extension (with or without dots, in any case) stands for; null if none."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.element_at(table, F.lower(F.regexp_replace(T.col(extension), r"^\.+", "")))


def inside_roots(path: str, roots: list[str]) -> bool:
    """Whether a path may be read: it must lie in one of the roots after following links; without roots none may."""
    real = Path(path).resolve()
    return any(real.is_relative_to(Path(r).resolve()) for r in roots)


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def _below(folder: str) -> Column:
    """The path under the folder; parts that begin with a dot mark hidden files."""
    root = folder.rstrip("/").split("://", 1)[-1].lstrip("/")
    return F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", ""), rf"^{_quoted(root)}/?", "")


def _quoted(x: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "/_" else c for c in x)


def discover(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Documents in a folder tree: path, folder, stem, file_type, size.  Hidden files, sidecars and other types are left
    out; contents are read only if ``content`` is asked for as one of ``more`` columns."""
    name = F.element_at(F.split("below", "/"), -1)
    rows = _binary(spark, folder).select("path", F.col("length").alias("size"), _below(folder).alias("below"), *more)
    rows = rows.where(~F.col("below").rlike(r"(^|/)\.") & ~F.col("below").endswith(SIDECAR)).withColumn("name", name)
    rows = rows.withColumn("file_type", file_type(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return rows.where("file_type is not null").select("path", F.regexp_replace("below", r"/?[^/]*$", "").alias("folder"), F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"), "file_type", "size", *more)


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Sidecar files: folder, stem, json (text)."""
    rows = _binary(spark, folder).withColumn("below", _below(folder)).where(F.col("below").endswith(SIDECAR))
    name = F.element_at(F.split("below", "/"), -1)
    return rows.select(F.regexp_replace("below", r"/?[^/]*$", "").alias("folder"), F.regexp_replace(name, r"\.metadata\.json$", "").alias("stem"), F.decode("content", "UTF-8").alias("json"))


def parsed_sidecars(rows: DataFrame, json: str = "json") -> DataFrame:
    """Adds ``sidecar`` (a struct) and ``errors`` (which rules it breaks; empty if none) to rows with sidecar text."""
    s = F.col("sidecar")
    read = rows.withColumn("sidecar", F.from_json(json, SIDECAR_SCHEMA, {"mode": "PERMISSIVE"}))
    filled = ("document.title", "document.category", "language", "source.url", "source.domain", "source.publisher", "security.classification", "provenance.retrieved_at", "provenance.retrieved_by")
    listed = ("tags", "acl.allow_roles")

    def at(path: str) -> Column:
        value = s
        for part in path.split("."):
            value = value[part]
        return value

    unreadable = F.col(json).isNull() | F.try_parse_json(json).isNull() | F.coalesce(F.try_to_number(F.get_json_object(json, "$.schema_version"), F.lit("999")).isNull(), F.lit(True))
    rules = [(at("schema_version") != 1, "unsupported schema_version")]
    rules += [(F.coalesce(at(p), F.lit("")) == "", f"{p} must not be empty") for p in filled]
    rules += [(F.coalesce(F.size(at(p)), F.lit(-1)) <= 0, f"{p} must contain at least one entry") for p in listed]
    chunking, ocr = s["ingestion"]["chunking"], s["ingestion"]["ocr"]
    rules += [
        (chunking["max_tokens"] == 0, "ingestion.chunking.max_tokens must be > 0"),
        ((chunking["overlap_ratio"] < 0) | (chunking["overlap_ratio"] >= 1), "ingestion.chunking.overlap_ratio must be in [0, 1)"),
        (ocr["timeout_secs"] == 0, "ingestion.ocr.timeout_secs must be > 0"),
    ]
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(said)) for test, said in rules)))
    return read.withColumn("errors", F.when(unreadable, F.array(F.lit("the sidecar is not readable"))).otherwise(broken))


def documents(spark: SparkSession, folder: str, extractors: Extractors | None = None) -> DataFrame:
    """Documents with text, the format's own tags (``native``) and sidecar: text is null, with an ``error``, if it is
    not UTF-8 or has no extractor.  Contents become text where they are read; only texts meet the sidecars."""
    found = discover(spark, folder, "content")
    if extractors:
        read = extractors.extract(found).withColumnRenamed("error", "unread")
    else:
        valid = F.is_valid_utf8(F.col("content").cast("string"))
        text = F.when(F.col("file_type").isin("text", "markdown") & valid, F.decode("content", "UTF-8"))
        unread = F.when(F.col("file_type") == "pdf", "pdf extraction needs a configured extractor").when(~valid, "the file is not valid UTF-8")
        read = found.select("*", text.alias("text"), F.lit(None).cast("map<string,string>").alias("native"), unread.alias("unread")).drop("content")
    sides = parsed_sidecars(sidecars(spark, folder)).withColumn("has_sidecar", F.lit(True))
    rows = read.join(sides, ["folder", "stem"], "left")
    return rows.withColumn("error", F.when(F.size("errors") > 0, F.array_join("errors", "; ")).otherwise(F.col("unread"))).drop("unread")


def needs_ocr(force: Column | str, text: Column | str, available: bool) -> Column:
    """A page's decision: ``ocr`` or ``skip`` where forced or without text, else ``native``."""
    wanted = T.col(force) | (F.length(T.trim_ws(F.coalesce(T.col(text), F.lit("")))) == 0)
    return F.when(wanted, F.lit("ocr" if available else "skip")).otherwise(F.lit("native"))


def ocr_settings(hints: Column | str, timeout: Column | str, language: str = "eng", seconds: int = 30) -> list[Column]:
    """OCR languages joined by plus signs (a default without hints), and the timeout, one second at least."""
    joined = F.concat_ws("+", T.col(hints))
    return [F.when(joined == "", F.lit(language)).otherwise(joined).alias("ocr_language"), F.greatest(F.lit(1), F.coalesce(T.col(timeout), F.lit(seconds))).cast("long").alias("ocr_timeout")]
