"""Incremental versions of the file-driven jobs with Structured Streaming.

Every sink writes one folder per micro-batch and overwrites it, so a batch that is run again
after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import leak as L
from assayer.operators import rules as R
from assayer.session import fresh_path


def run_available(
    stream: DataFrame,
    label: str,
    mode: str = "append",
    each: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Process what is there, then read back the batches (with their ``batch`` number)."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")

    def write(batch: DataFrame, number: int) -> None:
        part = each(batch) if each else batch
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def entry_violations(documents: DataFrame) -> DataFrame:
    """Violations of entry documents (row_id, doc) as they arrive; the rules are row-local."""
    return run_available(documents, "entry-violations", each=R.check_entries).drop("batch")


ARRIVALS = "run_id string, task_id string, kind string, n long, newest long"


def arrivals(predictions: DataFrame, time: str, delay: str, at: str | None = None) -> DataFrame:
    """(run_id, task_id, kind, n, newest, batch): what arrived as ``first``, as ``repeated`` and as too ``late``.

    A row is late if it is older than the newest time of earlier batches less ``delay`` (an interval as text); it is counted and changes
    nothing. The first other row of a (run, task) is its prediction, all further ones repeat it, in whatever batch they come.

    The state is the result itself, a folder per batch. A batch reads the folders of earlier batches only and overwrites its own, so one
    that is run again after a failure, whether or not it had been written, changes nothing. Tasks that were seen are joined with those of the
    batch; that table grows with the tasks, not with the rows.
    """
    spark = predictions.sparkSession
    at = at or fresh_path(spark, "arrivals")
    out, key = f"{at}/batches", ["run_id", "task_id"]
    stored = lambda: spark.read.schema(f"{ARRIVALS}, batch int").parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        timed = batch.select(*key, F.unix_millis(time).alias("ms"))
        if number:
            earlier = stored().where(F.col("batch") < number)
            known = earlier.where("kind = 'first'").select(*key, F.lit(True).alias("seen"))
            newest = F.timestamp_millis(F.lit(earlier.agg(F.max("newest")).first()[0]).cast("long"))
            oldest = F.unix_millis(newest - F.expr(f"interval {delay}"))
        else:
            known = spark.createDataFrame([], "run_id string, task_id string, seen boolean")
            oldest = F.lit(None).cast("long")
        late = F.coalesce(F.col("ms") < oldest, F.lit(False))
        counts = timed.groupBy(*key).agg(F.count_if(~late).alias("timely"), F.count_if(late).alias("late"), F.max("ms").alias("newest"))
        first = ((F.col("timely") > 0) & F.col("seen").isNull()).cast("long")
        kinds = {"first": first, "repeated": F.col("timely") - first, "late": F.col("late")}
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("n")) for k, n in kinds.items()])
        found = counts.join(known, key, "left").select(*key, F.explode(kinds).alias("k"), "newest").select(*key, "k.*", "newest")
        found.where("n > 0").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = predictions.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stored()


def session_progress(scores: DataFrame) -> DataFrame:
    """Running session counts; each batch writes the sessions it changed, the newest one counts."""
    running = scores.groupBy("run_id", "session_id").agg(
        F.count(F.lit(1)).alias("turns_total"),
        F.count("passed").alias("turns_scorable"),
        F.count_if("passed").alias("turns_passed"),
    )
    batches = run_available(running, "session-progress", mode="update")
    counts = ("turns_total", "turns_scorable", "turns_passed")
    newest = F.max(F.struct("batch", *counts)).alias("n")
    out = batches.groupBy("run_id", "session_id").agg(newest).select("run_id", "session_id", "n.*")
    return out.drop("batch").withColumn(
        "session_passed",
        F.when(F.col("turns_scorable") > 0, F.col("turns_passed") == F.col("turns_scorable")),
    )


def leaking_ids(documents: DataFrame, published: DataFrame) -> DataFrame:
    """(doc, id) of unpublished ids in arriving documents; the allowlist is static."""
    allow = L.expand_allowlist(published).select("id", F.lit(True).alias("known"))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(L.ID_PATTERN), F.lit(0)))
    ids = documents.select("doc", F.explode(found).alias("id"))
    unknown = ids.join(allow, "id", "left_outer").where(F.col("known").isNull())
    return run_available(unknown.select("doc", "id"), "leaking-ids").drop("batch")
