"""Structured Streaming extensions: windows over events, late data, incremental ingest, a stateful token bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder (or file) of Parquet as a stream, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = path.rstrip("/")
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file will do as well as a folder
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def tumbling(events: DataFrame, every: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts and value sums by window of event time (and keys)."""
    return _counted(events.withWatermark("ts", late), F.window("ts", every), *keys)


def sliding(events: DataFrame, size: str, step: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    return _counted(events.withWatermark("ts", late), F.window("ts", size, step), *keys)


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts by session: events of a key with gaps shorter than ``gap``."""
    return _counted(events.withWatermark("ts", late), F.session_window("ts", gap), *keys)


def _counted(events: DataFrame, window, *keys: str) -> DataFrame:
    got = events.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def limited(events: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """A token bucket for each key, kept in state between batches: key, ts, event_id, allowed."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for at in rows["ts"].astype("int64") / 1e9 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].map(lambda t: t.timestamp()):
            tokens = min(burst, tokens + (max(0.0, at - last) * rate if last is not None else 0.0))
            ok = tokens >= 1
            tokens -= ok
            last = at if last is None else max(last, at)
            allowed.append(bool(ok))
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({key: [k[0]] * len(rows), "ts": rows["ts"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(stream: DataFrame, handle: Callable[[DataFrame, int], object], checkpoint: str, **trigger):
    """Start incremental ingest: each micro-batch of new documents, with its number, goes to ``handle``; by default all
    that there is, then it ends."""
    return stream.writeStream.foreachBatch(lambda rows, batch: handle(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def collected(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a bounded stream to its end into an in-memory table (for tests and small results)."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
