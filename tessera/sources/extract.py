"""Text extraction by file type: a registry of extractors, applied to file contents in Arrow batches.

PDF and OCR libraries are not part of the engine: register an extractor for ``pdf`` that returns the pages' texts (and
layout spans, for heading detection) and it takes part like the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

PAGE_BREAK = "\f"


@dataclass
class Extracted:
    """The text of a file, and what the format says about it."""

    text: str
    tags: dict[str, str] = field(default_factory=dict)


Extractor = Callable[[bytes, str], Extracted]


def utf8(content: bytes, name: str) -> Extracted:
    """Text as it is; anything but UTF-8 is an error."""
    try:
        return Extracted(content.decode("utf-8"))
    except UnicodeDecodeError as e:
        raise ValueError(f"{name} is not valid UTF-8") from e


def paged(read: Callable[[bytes], tuple[list[str], dict[str, str]]], ocr: Callable[[bytes, int], str] | None = None, force_ocr: bool = False) -> Extractor:
    """An extractor from a function that gives page texts and document tags.

    Pages without text (all pages, if forced) go through ``ocr``, or are skipped without one; if that leaves nothing of
    a document with pages, it is an error.
    """

    def extract(content: bytes, name: str) -> Extracted:
        pages, tags = read(content)
        out = []
        for i, page in enumerate(pages):
            if force_ocr or not page.strip():
                out.append(ocr(content, i) if ocr else "")
            else:
                out.append(page)
        if pages and not any(p.strip() for p in out):
            raise ValueError(f"all pages of {name} need OCR, which is not available")
        return Extracted(PAGE_BREAK.join(out), {k: v for k, v in tags.items() if v})

    return extract


class Extractors:
    """Extractors by file type; a type can be registered once."""

    def __init__(self):
        self.known: dict[str, Extractor] = {}

    def register(self, kind: str, extractor: Extractor) -> Extractors:
        if kind in self.known:
            raise ValueError(f"an extractor for {kind!r} is registered already")
        self.known[kind] = extractor
        return self

    @classmethod
    def standard(cls) -> Extractors:
        return cls().register("text", utf8).register("markdown", utf8)

    def extract(self, files: DataFrame) -> DataFrame:
        """``files(path, file_type, content, ...)`` with ``text``, ``native`` (tags) and ``error`` in place of content."""
        known = dict(self.known)
        keep = [f for f in files.schema if f.name != "content"]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string, native map<string,string>, error string"])
        names = [f.name for f in keep]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, tags, errors = [], [], []
                for path, kind, content in zip(*(batch.column(c).to_pylist() for c in ("path", "file_type", "content")), strict=True):
                    got, error = Extracted(None), None
                    if kind not in known:
                        error = f"no extractor is configured for {kind}"
                    else:
                        try:
                            got = known[kind](content or b"", path.rsplit("/", 1)[-1])
                        except Exception as e:  # noqa: BLE001  one unreadable file must not fail the others
                            error = str(e)
                    texts.append(got.text)
                    tags.append(list(got.tags.items()))
                    errors.append(error)
                columns = [pa.array(texts, pa.string()), pa.array(tags, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, "text", "native", "error"])

        return files.mapInArrow(run, schema)


def merged_tags(metadata: dict, native: dict[str, str], kind: str = "pdf") -> dict:
    """Document metadata with a format's own tags under ``native.<kind>``; keys that are there win, and a value in the
    way that is no object is left as it is."""
    if not native:
        return metadata
    held = metadata.get("native", {})
    if not isinstance(held, dict) or not isinstance(held.get(kind, {}), dict):
        return metadata
    return metadata | {"native": held | {kind: native | held.get(kind, {})}}
