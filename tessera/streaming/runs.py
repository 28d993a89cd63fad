"""Agent runs as state in a stream: a run's age and its wait for approval, with a timer for each run.

A run expires a time to live after it began, unless it waits for approval; a waiting run expires once it is resolved, if it
is old by then.  State of an expired run is dropped, so the state holds the live runs alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TTL_S = 24 * 3600
OUT = "run_id string, event string, at timestamp"
#: State by key with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunSessions(StatefulProcessor):
    """Events ``started``, ``awaiting`` and ``resolved`` of a run; tells ``started``, ``awaiting``, ``resolved`` and ``expired``."""

    def __init__(self, ttl_s: int):
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "began long, awaiting boolean")

    def _expired(self, run_id: str) -> tuple[str, str, pd.Timestamp]:
        began, _ = self.run.get()
        self.run.clear()
        return run_id, "expired", pd.Timestamp(began + self.ttl_ms, unit="ms")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, (run_id,) = [], key
        seen = pd.concat(list(rows)).sort_values(["ts", "kind"], kind="stable")
        for ts, kind in zip(seen["ts"], seen["kind"], strict=True):
            at = int(ts.value // 1_000_000)
            if kind == "started" and not self.run.exists():
                self.run.update((at, False))
                self.handle.registerTimer(at + self.ttl_ms)
                out.append((run_id, kind, ts))
            elif kind in ("awaiting", "resolved") and self.run.exists():
                began, awaiting = self.run.get()
                if awaiting == (kind == "awaiting"):
                    continue
                self.run.update((began, kind == "awaiting"))
                out.append((run_id, kind, ts))
                if kind == "resolved" and at >= began + self.ttl_ms:
                    out.append(self._expired(run_id))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists() and not self.run.get()[1]:
            yield self._frame([self._expired(key[0])])
        else:
            yield self._frame([])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"run_id": pd.Series([r[0] for r in rows], dtype=object), "event": pd.Series([r[1] for r in rows], dtype=object), "at": pd.Series([r[2] for r in rows], dtype="datetime64[ns]")})


def run_sessions(events: DataFrame, ttl_s: int = TTL_S, late: str = "0 seconds") -> DataFrame:
    """What happens to the runs of ``events(run_id, ts, kind)``: run_id, event, at.  Time is the events' own; a run's timer
    goes off when the watermark has passed it."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = events.select("run_id", "ts", "kind").withWatermark("ts", late)
    return marked.groupBy("run_id").transformWithStateInPandas(RunSessions(ttl_s), OUT, "append", "eventTime")
