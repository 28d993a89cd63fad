from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import access
from tessera.streaming import events as V
from tessera.streaming import runs as R

BEGIN = datetime(2024, 5, 6)


def test_stream_of_runs_equals_pruned_runs(spark, tmp_path):
    """Runs expire in the stream as ``pruned_runs`` drops them from the table, batch by batch."""
    at = lambda hours: BEGIN + timedelta(hours=hours)
    batches = [
        [("a", at(0), "started"), ("b", at(1), "started"), ("c", at(2), "started"), ("b", at(3), "awaiting"), ("c", at(4), "awaiting"), ("a", at(5), "started")],
        [("d", at(20), "started"), ("c", at(21), "resolved"), ("x", at(21), "awaiting"), ("b", at(22), "awaiting")],
        [("e", at(26), "started"), ("e", at(30), "awaiting")],
        [("clock", at(50), "started")],
        [("b", at(51), "resolved"), ("e", at(51), "resolved"), ("clock", at(60), "awaiting")],
        [("clock", at(61), "resolved")],
    ]
    folder = f"file://{tmp_path}/events"
    for rows in batches:
        spark.createDataFrame(rows, "run_id string, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(folder)
    stream = V.read_table(spark, folder, files_per_trigger=1)
    told = V.collected(R.run_sessions(stream), "run_sessions", checkpoint=f"file://{tmp_path}/checkpoint").collect()
    got = {(r.run_id, r.event): r.at for r in told}
    assert len(got) == len(told)
    gone = {run: t for (run, event), t in got.items() if event == "expired"}
    assert gone == {"a": at(24), "b": at(25), "c": at(26), "d": at(44), "e": at(50)}
    assert ("x", "awaiting") not in got and got["c", "resolved"] == at(21) and got["a", "started"] == at(0)
    # The same from the table of runs, with what waits at the end.
    flat = [r for rows in batches for r in rows]
    began, waits = {}, {}
    for run, ts, kind in flat:
        if kind == "started":
            began.setdefault(run, ts)
        elif run in began:
            waits[run] = kind == "awaiting"
    table = spark.createDataFrame([(run, ts, waits.get(run, False)) for run, ts in began.items()], "run_id string, inserted_at timestamp, awaiting_approval boolean")
    stays = {r.run_id for r in access.pruned_runs(table, F.lit(at(61)).cast("timestamp")).collect()}
    assert stays == began.keys() - gone.keys()


def test_waiting_runs_do_not_expire(spark, tmp_path):
    rows = [("w", BEGIN, "started"), ("w", BEGIN + timedelta(hours=1), "awaiting"), ("v", BEGIN, "started")]
    late = [("clock", BEGIN + timedelta(hours=200), "started")]
    for batch in (rows, late, [("clock", BEGIN + timedelta(hours=201), "awaiting")]):
        spark.createDataFrame(batch, "run_id string, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/e")
    stream = V.read_table(spark, f"file://{tmp_path}/e", files_per_trigger=1)
    told = V.collected(R.run_sessions(stream), "waiting_runs", checkpoint=f"file://{tmp_path}/c").collect()
    assert {r.run_id for r in told if r.event == "expired"} == {"v"}
