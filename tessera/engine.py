"""One object over the engine's tables: ingest folders, search, answer, chat, look up, delete."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection
from functools import partial
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import vectors as V
from .operators import agents, cells, chat, embedding, fusion, hashed, ingest, retrieval, routing, stored, stores
from .operators import index as I
from .operators.snapshots import Change, Conflict, Snapshot, SnapshotLog
from .session import checkpointed, ensure_importable, folder_sizes, freed_shuffles, remove, shared_dir, splits, together
from .sources import files
from .sources.config import Settings
from .sources.extract import Extractors
from .sources.specs import Spec
from .streaming import events

T = TypeVar("T")

TABLES = {
    "documents": "tenant string, id string, title string, language string, collection string, checksum string, token_count long, created_at timestamp, updated_at timestamp",
    "points": "chunk_id string, payload struct<tenant:string,document_id:string,chunk_index:bigint,text:string,title:string,source_url:string,source_domain:string,language:string,collection:string,section_heading:string,tags:string>, dense array<float>",
    "postings": "tenant string, document_id string, collection string, chunk_id string, term string, tf int, length int, places array<int>",
    "conversations": "tenant string, id string, collection string, created_at timestamp",
    "messages": "tenant string, conversation_id string, part int, role string, content string, created_at timestamp",
    "runs": "tenant string, run_id string, agent_id string, collection string, query string, status string, steps array<string>, final_answer string, inserted_at timestamp",
    "terms": "tenant string, collection string, term string, df long",
    "stats": "tenant string, collection string, docs long, tokens long, chunks long",
}
#: Tables whose rows lie in the same buckets, with the columns of tenant and key, and the order inside a bucket.
SPACES = {
    "documents": {"documents": ("tenant", "id", "id"), "points": ("payload.tenant", "payload.document_id", "chunk_id"), "postings": ("tenant", "document_id", "term")},
    "talks": {"conversations": ("tenant", "id", "id"), "messages": ("tenant", "conversation_id", "created_at")},
    "runs": {"runs": ("tenant", "run_id", "run_id")},
}
SPACE_OF = {table: space for space, tables in SPACES.items() for table in tables}
#: Tables that are sums of parts: the columns that tell rows apart.
PARTS = {"terms": ("tenant", "collection", "term"), "stats": ("tenant", "collection")}
BUCKET_BYTES = 128 << 20
#: Parts of a table that are put together into one.
MOST_PARTS = 8
#: Bytes of chunks' texts whose postings a task sorts in memory, and of stored files that a task of a deletion does.
TASK_BYTES = 8 << 20
#: What documents a deletion marks, in the folder ``gone``.
MARKS = "tenant string, document_id string"
TRIES = 8


class Engine:
    """Tables live as Parquet under ``root``, in buckets by tenant and document, with one versioned state over all of them.

    A change writes the buckets it touches anew, in folders of their own, and then one commit that names them for all
    tables (``operators.snapshots``): readers see the whole change or nothing of it.  Two writers that touch different
    buckets both succeed; of two that touch the same, the second starts again from the first one's state.  A bucket
    that would pass ``bucket_bytes`` is written as several (``operators.hashed``).

    Postings are written at ingest; searches never read texts to find terms.  How many chunks hold a term, and how many
    documents, tokens and chunks a collection has, are kept as sums of signed changes, one part a commit.

    ``provider`` embeds batches of texts (see ``operators.embedding``); without one, ``embed`` maps a text column to a
    vector column, by default the deterministic stand-in with ``dim`` components.  ``extractors`` turn files into text;
    PDF files need one that is registered for them.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embed=None, dim: int = 64, model: chat.Model = chat.mock_model, provider: embedding.Provider | None = None, extractors: Extractors | None = None, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.settings = ensure_importable(spark), root.rstrip("/"), (settings or Settings()).checked()
        self.embed, self.dim, self.model, self.provider, self.extractors, self.bucket_bytes = embed or V.mock_embedding(dim), dim, model, provider, extractors, bucket_bytes
        self.log = SnapshotLog(spark, self.root)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last state, or that of an earlier version."""
        return self.log.latest() if version is None else self.log.at(version)

    def table(self, name: str, buckets: Collection[str] | None = None, at: Snapshot | None = None) -> DataFrame:
        """A table (or some of its buckets) as of ``at``, by default the last state."""
        at = at or self.snapshot()
        if name in PARTS:
            paths = [f"{self.root}/{name}/{p}" for p in at.parts.get(name, [])]
            rows = self._read(name, paths)
            keys = PARTS[name]
            return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in keys))
        chosen = self._units(SPACE_OF[name], buckets, at)
        rows = self._read(name, [f"{self.root}/{name}/{unit['at']}/bucket=b{b}" for b, unit in sorted(chosen.items()) if name in unit["has"]])
        n = sum(unit.get("marks", 0) for unit in chosen.values())
        if not n:
            return rows
        tenant, key, _ = SPACES[SPACE_OF[name]][name]
        gone = self._marks(chosen).withColumnsRenamed({"tenant": "gone_tenant", "document_id": "gone_id"})
        return rows.join(F.broadcast(gone) if n <= retrieval.SMALL_ROWS else gone, (F.col(tenant) == F.col("gone_tenant")) & (F.col(key) == F.col("gone_id")), "left_anti")

    def _units(self, space: str, buckets: Collection[str] | None, at: Snapshot) -> dict[str, dict]:
        units = at.units.get(space, {})
        return units if buckets is None else {b: units[b] for b in buckets if b in units}

    def _marks(self, units: dict[str, dict]) -> DataFrame:
        """The documents that deletions have marked in these buckets."""
        paths = [f"{self.root}/gone/{unit['gone']}/bucket=b{b}" for b, unit in sorted(units.items()) if unit.get("marks")]
        return self.spark.read.schema(MARKS).parquet(*paths) if paths else self.spark.createDataFrame([], MARKS).where(F.lit(False))

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name]).where(F.lit(False))  # known to be empty: joins with it vanish

    def _buckets_of(self, space: str, keys: DataFrame, at: Snapshot) -> dict[str, int]:
        """The buckets of ``keys(tenant, key, bytes)``, with the bytes that come to each: at most as many as there are."""
        name = hashed.bucket_name(hashed.key_hash("tenant", "key"), at.units.get(space, {}))
        return {r.b: r.n for r in keys.groupBy(name.alias("b")).agg(F.sum("bytes").alias("n")).collect()}

    def _tree(self, space: str, at: Snapshot, come: dict[str, int]) -> tuple[list[str], list[str]]:
        """The buckets that ``come`` (with the bytes that come to them) are written as, and all there are then."""
        old = at.units.get(space, {})
        new = [part for b, more in come.items() for part in hashed.split(b, old.get(b, {"bytes": 0})["bytes"] + more, self.bucket_bytes)]
        return new, [b for b in old if b not in come] + new

    def _rewrite(self, space: str, at: Snapshot, come: dict[str, int], rows: dict[str, DataFrame], placed: Collection[str] = (), marks: DataFrame | None = None, marked: dict[str, int] | None = None) -> Change:
        """Write the buckets ``come`` (with the bytes that come to them) anew: ``rows`` has all rows of each table there.
        Tables that are ``placed`` have the rows of a bucket in a few partitions already and are not shuffled.  The files
        of the buckets ``marked`` stay; ``marks(tenant, document_id, bucket)`` tells what is gone there, so many in each.

        The result is the change to commit.
        """
        new, tree = self._tree(space, at, come)
        folder = uuid.uuid4().hex
        if come:
            together(self.spark, *(partial(self._write, space, table, rows[table], folder, tree, table in placed) for table in SPACES[space]))
        change = self._change(space, at, come, new, folder)
        if marked:
            own = marks.withColumn("bucket", F.concat(F.lit("b"), "bucket")).hint("rebalance", F.col("bucket"))
            own.sortWithinPartitions("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/gone/{folder}")
            units = {b: at.units[space][b] | {"gone": folder, "marks": n} for b, n in marked.items()}
            change = Change({space: [*(change.gone[space] if come else ()), *marked]}, {space: change.come[space] | units})
        return change

    def _write(self, space: str, table: str, rows: DataFrame, folder: str, tree: list[str], placed: bool) -> None:
        tenant, key, order = SPACES[space][table]
        made = rows.select(*self._read(table, []).columns)
        made = made.withColumn("bucket", F.concat(F.lit("b"), hashed.bucket_name(hashed.key_hash(tenant, key), tree)))
        made = made if placed else made.hint("rebalance", F.col("bucket"))
        made.sortWithinPartitions("bucket", order).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{table}/{folder}")

    def _change(self, space: str, at: Snapshot, come: dict[str, int], new: list[str], folder: str) -> Change:
        """The change by which the buckets ``come`` are the ``new`` ones, which are written in ``folder``."""
        old, sizes, has = at.units.get(space, {}), dict.fromkeys(new, 0), {b: [] for b in new}
        for table in SPACES[space] if new else ():
            for name, size in folder_sizes(self.spark, f"{self.root}/{table}/{folder}").items():
                if name.startswith("bucket=b"):
                    sizes[name[8:]] += size
                    has[name[8:]].append(table)
        return Change({space: [b for b in come if b in old] or [""]}, {space: {b: {"at": folder, "bytes": sizes[b], "has": has[b]} for b in new}})

    def _add_parts(self, change: Change, **tables: DataFrame) -> None:
        """A part of each summed table, its files sorted by its keys, comes with the change."""

        def write(name: str, rows: DataFrame) -> None:
            folder, keys = uuid.uuid4().hex, PARTS[name]
            values = [c for c in self._read(name, []).columns if c not in keys]
            rows = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in values)).where(" or ".join(f"{c} != 0" for c in values))
            rows.sortWithinPartitions(*keys[1:], keys[0]).write.option("compression", "zstd").parquet(f"{self.root}/{name}/{folder}")
            change.parts_come[name] = [folder]

        together(self.spark, *(partial(write, name, rows) for name, rows in tables.items()))

    def collapse(self, name: str) -> None:
        """Put the parts of a summed table together."""
        at = self.snapshot()
        parts = at.parts.get(name, [])
        if len(parts) > 1:
            change = Change(parts_gone={name: parts})
            self._add_parts(change, **{name: self.table(name, at=at)})
            try:
                self.log.commit(at, change)
            except Conflict:
                pass  # another writer did it

    def _retried(self, attempt: Callable[[Snapshot], T]) -> T:
        """Run ``attempt``, which works from a state and commits, until nobody else was first; then tidy the parts."""
        for k in range(TRIES):
            try:
                out = attempt(self.snapshot())
                break
            except Conflict:
                if k == TRIES - 1:
                    raise
        for name, parts in self.snapshot().parts.items():
            if len(parts) > MOST_PARTS:
                self.collapse(name)
        return out

    def clean(self, keep: int = 1, older: float = 3600.0) -> list[str]:
        """Remove folders that none of the last ``keep`` versions needs and that are ``older`` seconds old."""
        return self.log.clean(self.root, [*TABLES, "cells", "gone"], keep, older)

    def purge(self) -> None:
        """Write the buckets where deletions have marked documents anew, without them; ``clean`` then removes the old files."""

        def attempt(at: Snapshot) -> None:
            come = {b: 0 for b, unit in at.units.get("documents", {}).items() if unit.get("marks")}
            if come:
                with splits(self.spark, TASK_BYTES):
                    change = self._rewrite("documents", at, come, {name: self.table(name, come, at) for name in SPACES["documents"]}, ("points", "postings"))
                self.log.commit(at, change)

        self._retried(attempt)

    def _vectors(self, rows: DataFrame, text: str) -> DataFrame:
        """Rows with ``dense``."""
        if self.provider:
            return embedding.embedded(rows, self.provider, self.dim, text)
        return rows.withColumn("dense", self.embed(F.col(text)))

    def ingest(self, folder: str, tenant: str, collection: str | None = None, dry_run: bool = False) -> DataFrame:
        """Ingest a folder: unchanged documents are skipped; returns the counters."""
        if self.settings.ingest_roots and not files.inside_roots(folder, list(self.settings.ingest_roots)):
            raise ValueError("the folder is outside the configured roots")
        return self.ingest_prepared(ingest.prepared(files.documents(self.spark, folder, self.extractors), tenant, collection, self.settings.collection), dry_run)

    def ingest_rows(self, rows: DataFrame, tenant: str, collection: str, stream: tuple[str, int] | None = None) -> DataFrame:
        """Ingest ``rows(document_id, text)``, with title, language and collection if there; of rows with one id the last by
        text stays."""
        return self.ingest_prepared(ingest.prepared_rows(rows, tenant, collection), stream=stream)

    def ingest_prepared(self, prepared: DataFrame, dry_run: bool = False, stream: tuple[str, int] | None = None) -> DataFrame:
        """Ingest the documents of ``operators.ingest.prepared``, in one commit.

        ``stream`` names a stream and its batch: a batch that was committed before changes nothing, and its counters
        are zeros.
        """
        held = []
        none = self.spark.createDataFrame([(0, 0, 0, 0)], ingest.COUNTERS)
        done = lambda at: bool(stream) and at.streams.get(stream[0], -1) >= stream[1]

        def attempt(at: Snapshot) -> DataFrame:
            if done(at):
                return none
            if not (dry_run or at.units.get("documents")):
                return self._first(at, prepared, stream)
            if not held:
                held.append(prepared.persist())
            # Only the buckets of the documents at hand tell which are unchanged.
            known = self._buckets_of("documents", prepared.select("tenant", F.col("document_id").alias("key"), F.lit(0).alias("bytes")), at)
            there = self.table("documents", known, at)
            docs = ingest.outcome(prepared, there)
            if known.keys() & at.units.get("documents", {}).keys():  # else no more than a column beside ``prepared``
                held.append(docs := docs.persist())
            chunks = ingest.chunk_rows(docs, self.settings.chunk_tokens, self.settings.chunk_overlap, ingest.METADATA).persist()
            held.append(chunks)
            told = ingest.counters(docs, chunks, dry_run)
            told = self.spark.createDataFrame(told.collect(), told.schema)
            if not dry_run:
                self.log.commit(at, self._ingested(at, docs, chunks, there, stream, held))
            return told

        try:
            return self._retried(attempt)
        except Conflict:
            if done(self.snapshot()):
                return none
            raise
        finally:
            for rows in held:
                rows.unpersist()

    def _ingested(self, at: Snapshot, docs: DataFrame, chunks: DataFrame, there: DataFrame, stream: tuple[str, int] | None, held: list[DataFrame]) -> Change:
        """The change that ``docs`` and their ``chunks`` make to the documents that are there; written, not committed."""
        changed = (docs.where("error is null and not skip").select("tenant", "document_id"))
        # Unchanged documents are touched only if their title, language or collection is another one now.
        moved = ingest.moved(docs, there).persist()
        entries = changed.unionByName(moved.select("tenant", F.col("id").alias("document_id")))
        fresh = chunks.select("tenant", F.col("document_id").alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) * 3 + 4 * self.dim).cast("long").alias("bytes"))
        come = self._buckets_of("documents", fresh.unionByName(entries.select("tenant", F.col("document_id").alias("key"), F.lit(64).cast("long").alias("bytes"))), at)
        if not come:
            return Change(streams=dict([stream] if stream else []))
        held.append(moved)
        p = F.col("payload")
        new_points = I.check_vectors(ingest.points_with(self._vectors(chunks, "text")), self.dim)
        new_postings = stored.postings(chunks, "tenant", "document_id", "collection", "chunk_id")
        points, postings, documents = (self.table(name, come, at) for name in ("points", "postings", "documents"))
        by_document = points.withColumns({"tenant": p["tenant"], "document_id": p["document_id"]})
        gone = retrieval.small(changed)
        rows = {
            "points": by_document.join(gone, ["tenant", "document_id"], "left_anti").select(*points.columns).unionByName(new_points),
            "postings": postings.join(gone, ["tenant", "document_id"], "left_anti").unionByName(new_postings.select(*postings.columns)),
            "documents": stores.upsert(documents, ingest.stored_documents(docs.where(~F.col("skip")), chunks, self.settings.chunk_tokens).unionByName(moved), ["tenant", "id"]),
        }
        change = self._rewrite("documents", at, come, rows)
        change.streams = dict([stream] if stream else [])
        # Rows that stayed in the buckets count on both sides.
        new = {name: self._written(change, name) for name in SPACES["documents"]}
        self._add_parts(change, terms=_terms(new["postings"], 1).unionByName(_terms(postings, -1)), stats=_documents(new["documents"], 1).unionByName(_documents(documents, -1)).unionByName(_chunks(new["points"], 1)).unionByName(_chunks(points, -1)))
        return change

    def _first(self, at: Snapshot, prepared: DataFrame, stream: tuple[str, int] | None) -> DataFrame:
        """Ingest the first documents of a store; returns the counters.

        The texts are computed once, into a folder that goes as soon as their points are written, and shuffled once, to
        their buckets.  The rest is made of the points where they lie, step by step, so that the disk holds no more than
        the store, the texts once and one shuffle.
        """
        staged, folder, key = f"{shared_dir(self.spark)}/staged-{uuid.uuid4().hex}", uuid.uuid4().hex, F.col("document_id").alias("key")
        with freed_shuffles(self.spark):
            try:
                prepared.write.option("compression", "zstd").parquet(staged)
                docs = ingest.outcome(self.spark.read.schema(prepared.schema).parquet(staged), self._read("documents", []))
                octets = F.octet_length("text")
                size = octets * 3 + F.ceil(octets / (4 * self.settings.chunk_tokens)) * 4 * self.dim + 64
                come = self._buckets_of("documents", docs.where(~F.col("skip")).select("tenant", key, size.cast("long").alias("bytes")), at)
                new, tree = self._tree("documents", at, come)
                points = self._read("points", [])
                if come:
                    chunks = self._dealt(ingest.chunk_rows(docs, self.settings.chunk_tokens, self.settings.chunk_overlap, ingest.METADATA), tree, sum(come.values()))
                    self._write("documents", "points", I.check_vectors(ingest.points_with(self._vectors(chunks, "text")), self.dim), folder, tree, True)
                    points = self._read("points", [f"{self.root}/points/{folder}"])
                units = points.select(*(F.col("payload")[c].alias(c) for c in ("tenant", "document_id", "collection", "text")), "chunk_id")
                told = ingest.counters(docs, units)
                told = self.spark.createDataFrame(told.collect(), told.schema)
                if come:
                    made = ingest.stored_documents(docs.where(~F.col("skip")), units, self.settings.chunk_tokens)
                    self._write("documents", "documents", stores.upsert(self._read("documents", []), made, ["tenant", "id"]), folder, tree, False)
            finally:
                remove(self.spark, staged)
            change = Change()
            if come:
                with splits(self.spark, TASK_BYTES // 2):
                    self._write("documents", "postings", stored.postings(units, "tenant", "document_id", "collection", "chunk_id"), folder, tree, True)
                change = self._change("documents", at, come, new, folder)
                rows = {name: self._written(change, name) for name in SPACES["documents"]}
                with splits(self.spark, BUCKET_BYTES):  # a task counts many postings, so that few terms are told by several
                    self._add_parts(change, terms=_terms(rows["postings"], 1), stats=_documents(rows["documents"], 1).unionByName(_chunks(rows["points"], 1)))
            change.streams = dict([stream] if stream else [])
            self.log.commit(at, change)
        return told

    def _dealt(self, chunks: DataFrame, tree: list[str], size: int) -> DataFrame:
        """Chunks by bucket, a large bucket's in several parts, so that a task can sort the postings of its own in memory."""
        parts = max(1, size // (3 * TASK_BYTES))
        each = max(1, self.bucket_bytes // (3 * TASK_BYTES))
        bucket = hashed.bucket_name(hashed.key_hash("tenant", "document_id"), tree)
        return chunks.repartition(parts, bucket, F.pmod(F.xxhash64("chunk_id"), F.lit(each)))

    def _written(self, change: Change, name: str) -> DataFrame:
        """A table's rows in the buckets that a change brings."""
        units = change.come.get(SPACE_OF[name], {})
        return self._read(name, [f"{self.root}/{name}/{unit['at']}/bucket=b{b}" for b, unit in sorted(units.items()) if name in unit["has"]])

    def follow(self, stream: DataFrame, tenant: str, collection: str, checkpoint: str, name: str, **trigger) -> StreamingQuery:
        """Ingest a stream of ``(document_id, text)``: each micro-batch is one commit that carries the batch's number, so
        a batch that Spark runs again changes nothing.  ``name`` stands for the stream as long as its checkpoint does."""
        return events.ingest_stream(stream, lambda rows, batch: self.ingest_rows(rows, tenant, collection, (name, batch)), checkpoint, **trigger)

    def failures(self, folder: str, tenant: str, collection: str | None = None) -> DataFrame:
        """A row (path, error) for each document of a folder that cannot be ingested."""
        return ingest.failures(ingest.prepared(files.documents(self.spark, folder, self.extractors), tenant, collection, self.settings.collection))

    def _points(self, tenant: str, collection: str, at: Snapshot | None = None) -> DataFrame:
        p = F.col("payload")
        return self.table("points", at=at).where((p["tenant"] == tenant) & (p["collection"] == collection))

    def search_dense(self, queries: DataFrame, tenant: str, collection: str, k: int | None = None, at: Snapshot | None = None, probes: int | None = None) -> DataFrame:
        """Top k of each ``queries(query_id, query)`` by cosine: exactly, by a scan, or with ``probes`` from the vector index
        (``index_vectors``), which then visits so many of its cells for each query."""
        at, k = at or self.snapshot(), k or self.settings.dense_top_k
        asked = self._vectors(queries.select("query_id", "query"), "query").select("query_id", F.col("dense").alias("vector"))
        if probes is not None and _cell_name(tenant, collection) in at.units.get("cells", {}):
            return self._near(checkpointed(asked), tenant, collection, k, at, probes)
        return retrieval.dense_topk(asked, self._points(tenant, collection, at).select("chunk_id", F.col("dense").alias("vector")), k)

    def index_vectors(self, tenant: str, collection: str, count: int | None = None) -> None:
        """Index the vectors of a collection in cells.  Later changes need no new index: buckets that were written since are
        scanned beside it."""
        at, folder, p = self.snapshot(), uuid.uuid4().hex, F.col("payload")
        # A vector's name begins with its document's hash, which tells its bucket.
        place = F.concat(F.lpad(F.hex(hashed.key_hash(p["tenant"], p["document_id"])), 16, "0"), "chunk_id").alias("place")
        cells.build(self._points(tenant, collection, at).select(place, F.col("dense").alias("vector")), f"{self.root}/cells/{folder}", "place", count)
        name = _cell_name(tenant, collection)
        self.log.commit(at, Change({"cells": [name]}, {"cells": {name: {"at": folder, "version": at.version}}}))

    def _near(self, asked: DataFrame, tenant: str, collection: str, k: int, at: Snapshot, probes: int) -> DataFrame:
        own = at.units["cells"][_cell_name(tenant, collection)]
        index = cells.read(self.spark, f"{self.root}/cells/{own['at']}", "place")
        then, now = self.log.at(own["version"]).units.get("documents", {}), at.units.get("documents", {})
        unchanged = sorted(b for b, unit in now.items() if then.get(b) == unit)
        hash_of = F.conv(F.substring("place", 1, 16), 16, -10).cast("long")
        bucket = hashed.bucket_name(hash_of, now)
        if len(unchanged) < len(now):  # rows of buckets that were written since are not asked in the index
            still = self.spark.createDataFrame([(b,) for b in unchanged], "still string")
            index.codes = index.codes.join(F.broadcast(still), bucket == F.col("still"), "left_semi")
        kept = checkpointed(cells.survivors(asked, index, k, probes).withColumn("bucket", bucket))
        there = {r.bucket for r in kept.select("bucket").distinct().collect()}
        p = F.col("payload")
        mine = lambda rows: rows.where((p["tenant"] == tenant) & (p["collection"] == collection)).select("chunk_id", F.col("dense").alias("vector"))
        found = cells.rescored(kept.select("query_id", F.substring("place", 17, 1 << 20).alias("chunk_id")), asked, mine(self.table("points", there, at)), "chunk_id")
        fresh = retrieval.dense_topk(asked, mine(self.table("points", now.keys() - set(unchanged), at)), k).drop("rank")
        return retrieval.top(found.unionByName(fresh), k, F.desc("score"), "chunk_id")

    def search_sparse(self, queries: DataFrame, tenant: str, collection: str, k: int | None = None, at: Snapshot | None = None) -> DataFrame:
        """Top k by BM25 from the stored postings; frequencies cover the whole collection, of all tenants, and come from
        the stored sums."""
        return retrieval.stored_topk(queries, self.index(tenant, collection, at), k or self.settings.sparse_top_k)

    def index(self, tenant: str, collection: str, at: Snapshot | None = None) -> stored.StoredIndex:
        """A tenant's postings of a collection, with the collection's frequencies and number of chunks."""
        at = at or self.snapshot()
        mine = lambda rows: rows.where((F.col("tenant") == tenant) & (F.col("collection") == collection))
        terms = self.table("terms", at=at).where(F.col("collection") == collection).groupBy("term").agg(F.sum("df").alias("df"))
        total = self.table("stats", at=at).where(F.col("collection") == collection).agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n"))
        return stored.StoredIndex(mine(self.table("postings", at=at)), terms, self._points(tenant, collection, at).select("chunk_id"), "chunk_id", total)

    def search_text(self, queries: DataFrame, tenant: str, collection: str, k: int | None = None) -> DataFrame:
        """Top k of each web-search query by cover density, from the stored places, with texts and metadata."""
        at = self.snapshot()
        hits = retrieval.stored_fts(queries, self.index(tenant, collection, at), k or retrieval.FTS_K)
        return self._texts(tenant, collection, at).join(retrieval.small(hits), "chunk_id")

    def _texts(self, tenant: str, collection: str, at: Snapshot) -> DataFrame:
        p = F.col("payload")
        return self._points(tenant, collection, at).select("chunk_id", *(p[c].alias(c) for c in ("document_id", "chunk_index", "text", "title")))

    def search_hybrid(self, queries: DataFrame, tenant: str, collection: str, **k: int) -> DataFrame:
        """Both legs fused by rank, with texts and metadata; ``probes`` as in ``search_dense``."""
        at = self.snapshot()
        legs = self.search_dense(queries, tenant, collection, k.get("dense_k"), at, k.get("probes")), self.search_sparse(queries, tenant, collection, k.get("sparse_k"), at)
        return self._texts(tenant, collection, at).join(retrieval.small(fusion.hybrid(*legs, k=k.get("rrf_k", self.settings.rrf_k))), "chunk_id")

    def retrieve(self, queries: DataFrame, tenant: str, collection: str, profile: str = "simple_hybrid", before: int = 1, after: int = 1, **k: int) -> DataFrame:
        """The chunks of a retrieval profile for each query, in order: query_id, chunk_id, document_id, chunk_index, text,
        title, fused_score (falling with the place) and rank.

        ``lexical_first`` puts full-text hits before hybrid ones, ``broad_then_expand`` the chunks around each hybrid hit
        behind them; of repeated chunks the first stays.
        """
        if profile not in retrieval.PROFILES:
            raise ValueError(f"unknown retrieval profile {profile!r}")
        columns = ("query_id", "chunk_id", "document_id", "chunk_index", "text", "title")
        hybrid = checkpointed(self.search_hybrid(queries, tenant, collection, **k))
        stages = {"hybrid": hybrid.select(*columns, "rank")}
        if "fts" in retrieval.PROFILES[profile]:
            stages["fts"] = self.search_text(queries, tenant, collection).select(*columns, "rank")
        if "neighbours" in retrieval.PROFILES[profile]:
            chunks = self._texts(tenant, collection, self.snapshot()).withColumn("tenant", F.lit(tenant))
            anchors = hybrid.withColumn("tenant", F.lit(tenant))
            near = retrieval.neighbours(anchors, chunks.select("tenant", "document_id", "chunk_index", "text", "title"), before, after)
            places = hybrid.select("query_id", "document_id", F.col("chunk_index").alias("anchor"), F.col("rank").alias("of"))
            near = near.join(retrieval.small(places), ["query_id", "document_id", "anchor"]).withColumn("rank", F.col("of") * (before + after + 1) + F.col("chunk_index") - F.col("anchor"))
            stages["neighbours"] = near.withColumn("title", F.lit(None).cast("string")).select(*columns, "rank")
        found = retrieval.run_profile(profile, stages)
        return found.select(*columns, (F.lit(1.0) / (self.settings.rrf_k + F.col("position"))).alias("fused_score"), F.col("position").alias("rank"))

    def run_agents(self, spec: Spec, requests: DataFrame, tenant: str, collection: str) -> DataFrame:
        """Run an agent graph for ``requests(run_id, query)``, each with the retrieval profile that its route asks for; the
        runs are kept."""
        asked = requests.select(F.col("run_id").cast("string").alias("run_id"), F.col("run_id").cast("string").alias("query_id"), "query")
        return self._executed(spec, asked, tenant, collection)

    def decide(self, spec: Spec, decisions: DataFrame, tenant: str, collection: str) -> DataFrame:
        """Go on with the tenant's waiting runs that ``decisions(run_id, decision, reason)`` names."""
        waiting = self.table("runs").where((F.col("tenant") == tenant) & (F.col("collection") == collection) & (F.col("agent_id") == spec.agent_id))
        ready = agents.decided(waiting, decisions.withColumn("tenant", F.lit(tenant)))
        return self._executed(spec, ready.select("run_id", F.col("run_id").alias("query_id"), "query", "decision", "reason"), tenant, collection)

    def _executed(self, spec: Spec, asked: DataFrame, tenant: str, collection: str) -> DataFrame:
        asked = checkpointed(asked)
        routed = checkpointed(routing.route(asked.select("query_id", "query")).select("query_id", "query", "retrieval_profile"))
        hits = None
        for profile in sorted(r.retrieval_profile for r in routed.select("retrieval_profile").distinct().collect()):  # three at most
            found = self.retrieve(routed.where(F.col("retrieval_profile") == profile).select("query_id", "query"), tenant, collection, profile)
            hits = found if hits is None else hits.unionByName(found)
        if hits is None:
            return self.spark.createDataFrame([], TABLES["runs"])
        done = agents.execute(spec, asked, agents.retrieval_tasks(checkpointed(hits), self.model))
        answer = F.col("final_answer") if "final_answer" in done.columns else F.lit(None).cast("string")
        named = done.select(F.lit(tenant).alias("tenant"), "run_id", F.lit(spec.agent_id).alias("agent_id"), F.lit(collection).alias("collection"), "query", "status", "steps", answer.alias("final_answer"), F.current_timestamp().alias("inserted_at"))
        new = checkpointed(named)

        def attempt(at: Snapshot) -> None:
            come = self._buckets_of("runs", new.select("tenant", F.col("run_id").alias("key"), F.lit(512).alias("bytes")), at)
            if come:
                kept = self.table("runs", come, at).join(new.select("tenant", "run_id"), ["tenant", "run_id"], "left_anti")
                self.log.commit(at, self._rewrite("runs", at, come, {"runs": kept.unionByName(new)}))

        self._retried(attempt)
        return new

    def runs(self, tenant: str, agent: str | None = None) -> DataFrame:
        """A tenant's runs (of one agent, if given); other tenants' runs are as good as unknown."""
        return agents.runs_of(self.table("runs"), tenant, agent)

    def answer(self, queries: DataFrame, tenant: str, collection: str) -> DataFrame:
        """Answers with citations: hybrid search, context, prompt, model."""
        return chat.single_shot(queries, self.search_hybrid(queries, tenant, collection), self.model, max_tokens=self.settings.context_tokens, max_chunks=self.settings.context_chunks)

    def chat(self, requests: DataFrame, tenant: str, collection: str) -> DataFrame:
        """Answers to ``requests(query_id, conversation_id, query)``, kept as turns of their conversations.

        A null conversation_id starts a conversation.  Requests for a conversation that the tenant does not have, or of
        another collection, get an ``error`` and no answer.  A request and its answer are saved in one write, and only
        where there is an answer.
        """
        asked = requests.select("query_id", "conversation_id", "query", F.lit(tenant).alias("tenant"), F.lit(collection).alias("collection"))
        known = chat.resolved(asked, self.table("conversations")).withColumn("conversation_id", F.when(F.col("error").isNull(), F.coalesce("conversation_id", F.expr("uuid()"))).otherwise(F.col("conversation_id")))
        known = checkpointed(known)
        fine = known.where("error is null")
        told = checkpointed(self.answer(fine.select("query_id", "query"), tenant, collection).select("query_id", "answer", "citations"))
        now = F.current_timestamp()
        turns = chat.turn_pairs(fine.join(told, "query_id")).withColumn("created_at", now)
        new = fine.where("is_new").select("tenant", F.col("conversation_id").alias("id"), "collection", now.alias("created_at"))
        new, turns = checkpointed(new), checkpointed(turns)
        keys = new.select("tenant", F.col("id").alias("key"), F.lit(64).alias("bytes")).unionByName(turns.select("tenant", F.col("conversation_id").alias("key"), (F.coalesce(F.octet_length("content"), F.lit(0)) + 64).alias("bytes")))

        def attempt(at: Snapshot) -> None:
            come = self._buckets_of("talks", keys, at)
            if come:
                rows = {name: self.table(name, come, at).unionByName(more) for name, more in (("conversations", new), ("messages", turns))}
                self.log.commit(at, self._rewrite("talks", at, come, rows))

        self._retried(attempt)
        return known.select("query_id", "conversation_id", "query", "error").join(told, "query_id", "left")

    def history(self, tenant: str, limit: int) -> DataFrame:
        """The last ``limit`` messages of each of a tenant's conversations, in order."""
        return chat.latest_messages(self.table("messages").where(F.col("tenant") == tenant), limit, order=("created_at", "part"))

    def stats(self, tenant: str) -> DataFrame:
        """Documents, tokens and their average of each of a tenant's collections, from the stored sums."""
        sums = self.table("stats").where(F.col("tenant") == tenant).select("tenant", "collection", F.col("docs").alias("total_docs"), F.col("tokens").alias("total_tokens"))
        return sums.withColumn("avgdl", F.when(F.col("total_docs") > 0, F.col("total_tokens") / F.col("total_docs")).otherwise(F.lit(0.0)))

    def delete(self, tenant: str, document_id: str) -> None:
        """Remove a document and its index rows, in one commit."""
        self.delete_all(self.spark.createDataFrame([(tenant, document_id)], "tenant string, document_id string"))

    def delete_all(self, gone: DataFrame) -> None:
        """Remove the documents ``gone(tenant, document_id)`` and their index rows, in one commit."""
        gone = checkpointed(gone.select("tenant", "document_id").distinct())

        def attempt(at: Snapshot) -> None:
            come = self._buckets_of("documents", gone.select("tenant", F.col("document_id").alias("key"), F.lit(0).alias("bytes")), at)
            come = {b: n for b, n in come.items() if b in at.units.get("documents", {})}
            if not come:
                return
            p = F.col("payload")
            points, postings = self.table("points", come, at).withColumns({"tenant": p["tenant"], "document_id": p["document_id"]}), self.table("postings", come, at)
            documents = self.table("documents", come, at).withColumnRenamed("id", "document_id")
            asked = retrieval.small(gone)
            pick = lambda rows, how: rows.join(asked, ["tenant", "document_id"], how)
            # Where half the documents stay, the others are marked; the files of other buckets are written anew.
            units = self._units("documents", come, at)
            bucket = hashed.bucket_name(hashed.key_hash("tenant", "document_id"), at.units["documents"]).alias("bucket")
            marks = self._marks(units).unionByName(pick(documents, "left_semi").select("tenant", "document_id")).select("*", bucket)
            there = {r.bucket: r["count"] for r in documents.select(bucket).groupBy("bucket").count().collect()}
            n = {r.bucket: r["count"] for r in marks.groupBy("bucket").count().collect()}
            n = {b: k for b, k in n.items() if k > units[b].get("marks", 0)}
            if not n:
                return
            marked = {b: k for b, k in n.items() if 2 * k <= there.get(b, 0) + units[b].get("marks", 0)}
            anew = {b: come[b] for b in n if b not in marked}
            left = {
                "points": pick(self.table("points", anew, at).withColumns({"tenant": p["tenant"], "document_id": p["document_id"]}), "left_anti"),
                "postings": pick(self.table("postings", anew, at), "left_anti"),
                "documents": pick(self.table("documents", anew, at).withColumnRenamed("id", "document_id"), "left_anti").withColumnRenamed("document_id", "id"),
            }
            # Files hold one bucket's rows each: what stays of some of them is sorted and written by the task that reads them.
            with splits(self.spark, TASK_BYTES):
                change = self._rewrite("documents", at, anew, left, ("points", "postings"), marks.where(F.col("bucket").isin(*marked)), marked)
            self._add_parts(change, terms=_terms(pick(postings, "left_semi"), -1), stats=_documents(pick(documents, "left_semi"), -1).unionByName(_chunks(pick(points, "left_semi"), -1)))
            self.log.commit(at, change)

        self._retried(attempt)


def _cell_name(tenant: str, collection: str) -> str:
    return f"{tenant}/{collection}"


def _terms(postings: DataFrame, sign: int) -> DataFrame:
    """Signed numbers of chunks that hold each term."""
    return postings.groupBy("tenant", "collection", "term").agg((F.count(F.lit(1)) * sign).alias("df"))


def _documents(documents: DataFrame, sign: int) -> DataFrame:
    return documents.groupBy("tenant", "collection").agg((F.count(F.lit(1)) * sign).alias("docs"), (F.coalesce(F.sum("token_count"), F.lit(0)) * sign).alias("tokens"), F.lit(0).cast("long").alias("chunks"))


def _chunks(points: DataFrame, sign: int) -> DataFrame:
    p = F.col("payload")
    return points.groupBy(p["tenant"].alias("tenant"), p["collection"].alias("collection")).agg(F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens"), (F.count(F.lit(1)) * sign).alias("chunks"))
