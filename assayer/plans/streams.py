"""Streaming queries: the given tables arrive as files, every query runs until all is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.plans import boards, leaks
from assayer.plans.registry import query
from assayer.plans.rollups import SCORES, scores
from assayer.session import fresh_path, table
from assayer.streaming import live


def _arrive(df, label, files: int | None = None):
    """Write a frame and read it as a stream; with ``files``, in as many parts and one part a batch."""
    path = fresh_path(df.sparkSession, label)
    (df.repartition(files) if files else df).write.parquet(path)
    stream = df.sparkSession.readStream.schema(df.schema)
    return (stream.option("maxFilesPerTrigger", 1) if files else stream).parquet(path)


# remainder of the supplier's key -> rules that its entry breaks, beside metrics without a mean, which the oracle counts by their own
BROKEN = {
    1: "pattern", 2: "required unexpected", 3: "enum", 4: "minimum run_count", 5: "type", 6: "unexpected", 7: "min_length",
    8: "enum", 9: "required unexpected", 10: "type", 11: "enum", 13: "maximum", 14: "null_reason unexpected",
    15: "mean_of_runs", 16: "null_reason", 17: "run_count", 20: "type",
}


@query(
    "entry_stream",
    "SELECT rule, count(*)::BIGINT AS n FROM (SELECT r.rule FROM supplier, (VALUES "
    + ", ".join(f"({k}, '{rule}')" for k, rules in BROKEN.items() for rule in rules.split())
    + """) r(k, rule) WHERE s_suppkey % 30 = r.k AND NOT (r.k = 14 AND s_suppkey % 13 = 0)
    UNION ALL SELECT 'required' FROM supplier WHERE s_suppkey % 9 = 0
    UNION ALL SELECT 'required' FROM supplier WHERE s_suppkey % 4 = 0
    UNION ALL SELECT 'required' FROM supplier WHERE s_suppkey % 13 = 0 OR s_suppkey % 30 = 14) v GROUP BY rule
    """,
)
def entry_stream(spark, sf):
    """Every violation of every rule over entries that arrive in three batches."""
    docs = _arrive(boards.documents(spark, sf), "entry-docs", files=3)
    return live.entry_violations(docs).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _arrive_in_order(parts, label, files: int = 4):
    """Write frames one after the other, each as ``files`` files, and read them as a stream, a frame a batch."""
    path, spark = fresh_path(parts[0].sparkSession, label), parts[0].sparkSession
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


@query(
    "prediction_stream",
    """
    WITH e AS (SELECT event_type AS run_id, event_id, user_id, epoch_ms(ts) AS ms FROM events),
    p AS (SELECT *, CASE WHEN event_id % 20 = 0 THEN 2 ELSE 3 * (ms - min(ms) OVER ()) // (max(ms) OVER () - min(ms) OVER () + 1) END AS part FROM e),
    w AS (SELECT *, (SELECT max(ms) - 7200000 FROM p b WHERE b.part < p.part) AS oldest FROM p),
    r AS (SELECT run_id, coalesce(ms < oldest, FALSE) AS late, CASE WHEN user_id % 5 = 0 THEN 2 ELSE 1 END AS copies FROM w)
    SELECT run_id, count(*) FILTER (WHERE NOT late)::BIGINT AS first,
           coalesce(sum(copies - 1) FILTER (WHERE NOT late), 0)::BIGINT AS repeated, coalesce(sum(copies) FILTER (WHERE late), 0)::BIGINT AS late
    FROM r GROUP BY run_id
    """,
)
def prediction_stream(spark, sf):
    """Events are predictions that arrive in three parts by time; those of every fifth user are sent twice, and every twentieth comes with the last part."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"),
        F.col("event_id").cast("string").alias("task_id"),
        F.col("ts").cast("timestamp").alias("sent_at"),
        F.when(F.col("user_id") % 5 == 0, 2).otherwise(1).alias("copies"),
        (F.col("event_id") % 20 == 0).alias("held"),
    )
    ms = F.unix_millis("sent_at")
    low, high = e.agg(F.min(ms), F.max(ms)).first()
    third = F.when(F.col("held"), 2).otherwise(F.expr(f"3 * (unix_millis(sent_at) - {low or 0}) div {(high or 0) - (low or 0) + 1}"))
    sent = e.withColumn("part", third).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    parts = [sent.where(F.col("part") == i).select("run_id", "task_id", "sent_at") for i in range(3)]
    found = live.arrivals(_arrive_in_order(parts, "predictions"), "sent_at", "2 hours")
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    return found.groupBy("run_id").agg(count("first"), count("repeated"), count("late"))


@query(
    "session_stream",
    SCORES
    + """
    SELECT run_id, session_id, count(*)::BIGINT AS turns_total, count(passed)::BIGINT AS turns_scorable,
           count(*) FILTER (WHERE passed)::BIGINT AS turns_passed,
           CASE WHEN count(passed) > 0 THEN count(*) FILTER (WHERE passed) = count(passed) END AS session_passed
    FROM s GROUP BY ALL
    """,
)
def session_stream(spark, sf):
    s = scores(spark, sf).select("run_id", "session_id", "task_id", "passed")
    return live.session_progress(_arrive(s, "scores"))


@query("leak_stream", leaks.FILES + "SELECT doc, id FROM u")
def leak_stream(spark, sf):
    docs = leaks._files(spark, sf).select("doc", "text")
    return live.leaking_ids(_arrive(docs, "docs"), leaks._published(spark, sf))
