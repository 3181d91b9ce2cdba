"""Writers of scores and board rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Scalar columns only: array, map and struct columns stay in the JSON output."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, nested)])


def write_scores(scores: DataFrame, out: str, by: str = "run_id") -> None:
    """Task scores as JSON and as flat CSV with a header, one folder per run."""
    scores.write.mode("overwrite").partitionBy(by).json(f"{out}/task_scores_json")
    flat(scores).write.mode("overwrite").partitionBy(by).option("header", True).csv(
        f"{out}/task_scores_csv"
    )


def write_summary(summary: DataFrame, sessions: DataFrame, rows: DataFrame, out: str) -> None:
    summary.write.mode("overwrite").json(f"{out}/scores_summary")
    sessions.write.mode("overwrite").json(f"{out}/session_scores")
    rows.write.mode("overwrite").json(f"{out}/board_rows")


def board_row(summary: DataFrame, mode: Column, scorer: str, scored_at: Column) -> DataFrame:
    """One line per run for the board; running the reference statements is a certification."""
    certified = mode == "gold-sql"
    return summary.select(
        "run_id",
        mode.alias("mode"),
        certified.alias("is_certification"),
        F.when(certified, "certification").otherwise("agent").alias("row_type"),
        "tasks_total",
        "tasks_passed",
        "task_success_rate",
        "rubric_pending_count",
        "macro_score",
        "avg_row_f1",
        "avg_latency_seconds",
        "total_cost_usd",
        scored_at.alias("scored_at_utc"),
        F.lit(scorer).alias("scorer_version"),
    )


def multirun_board_row(
    headline: DataFrame, means: DataFrame, per_run: DataFrame, run_set: str, n_runs: int,
    scorer: str, scored_at: Column,
) -> DataFrame:
    """One line for a set of runs; ``per_run`` has one row per run of the set."""
    rates = per_run.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("run_id", "task_success_rate"))),
            lambda r: r["task_success_rate"],
        ).alias("per_run_task_success_rate")
    )
    one = F.lit(1).alias("_one")
    return (
        headline.select("*", one)
        .join(means.select("*", one), "_one")
        .join(rates.select("*", one), "_one")
        .select(
            F.lit(run_set).alias("run_id"),
            F.lit("submission").alias("mode"),
            F.lit(False).alias("is_certification"),
            F.lit("agent").alias("row_type"),
            F.lit(n_runs).alias("n_runs"),
            "tasks_total",
            "tasks_passed",
            F.col("mean_pass_share").alias("task_success_rate"),
            "mean_pass_share",
            "mean_pass_share_native",
            "mean_any_pass",
            "all_pass_rate",
            "transpiled_count",
            "per_run_task_success_rate",
            "rubric_pending_count",
            F.col("mean_pass_share").alias("macro_score"),
            "avg_row_f1",
            "avg_latency_seconds",
            "total_cost_usd",
            scored_at.alias("scored_at_utc"),
            F.lit(scorer).alias("scorer_version"),
        )
    )
