"""Streams over several batches, with repeated and late rows, and a restart in between."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from assayer.streaming import live

SCHEMA = "run_id string, task_id string, sent_at timestamp"
NOON = datetime(2026, 1, 1, 12)


def at(minutes):
    return NOON + timedelta(minutes=minutes)


def test_arrivals_over_batches_and_a_restart(spark, tmp_path):
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    batches = [
        [("r", "a", at(0)), ("r", "a", at(1)), ("r", "b", at(300))],
        [("r", "c", at(10)), ("r", "b", at(299)), ("r", "d", at(200)), ("s", "a", at(301))],
        [("r", "a", at(500)), ("r", "c", at(400)), ("r", "d", at(179)), ("s", "z", at(0)), ("s", "z", at(1))],
    ]

    def run(parts):
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        found = live.arrivals(stream, "sent_at", "2 hours", kept)
        return {(r.run_id, r.task_id, r.kind): r.n for r in found.groupBy("run_id", "task_id", "kind").agg(F.sum("n").alias("n")).collect()}

    early = {("r", "a", "first"): 1, ("r", "a", "repeated"): 1, ("r", "b", "first"): 1, ("r", "c", "late"): 1,
             ("r", "b", "repeated"): 1, ("r", "d", "first"): 1, ("s", "a", "first"): 1}
    assert run(batches[:2]) == early
    late = early | {("r", "a", "repeated"): 2, ("r", "c", "first"): 1, ("r", "d", "late"): 1, ("s", "z", "late"): 2}
    assert run(batches[2:]) == late
    assert run([]) == late


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    source, kept = str(tmp_path / "in"), tmp_path / "kept"
    for part in ([("r", "a", at(0)), ("r", "b", at(0))], [("r", "a", at(1)), ("r", "c", at(2))]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(live.arrivals(stream(), "sent_at", "2 hours", str(kept)))
    for done in (kept / "state" / "commits").iterdir():  # as if the last batch had been written but not noted as done
        if done.name.strip(".").split(".")[0] == "1":
            done.unlink()
    assert rows(live.arrivals(stream(), "sent_at", "2 hours", str(kept))) == want
    assert sum(r[3] for r in want) == 4
