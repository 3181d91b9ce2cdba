"""Roll-ups of verdicts over tasks, sessions and repeated runs.

``scores`` holds one row per (run, task); ``passed`` is NULL for tasks outside every rate. Each
roll-up is one grouped aggregate with map-side combining. Identifier lists stay frames: nothing
collects the ids of a whole run into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = ("tier", "sql_difficulty", "primary_axis", "answer_type")


def scorable(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("passed").isNotNull())


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def mean_or_zero(c: str | Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def error_of() -> Column:
    """The label of a row; a failure without one is a plain mismatch."""
    return F.coalesce("error_type", F.when(~F.col("passed"), "answer_mismatch"))


def group_accuracy(scores: DataFrame, by: tuple[str, ...] = GROUPS) -> DataFrame:
    """Counts and means per value of each grouping attribute, all attributes in one pass."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in by]
    values = ["run_id", "passed", "score", "row_f1"]
    s = scorable(scores).select(*keys, *values)
    sets = [["run_id", F.col(c)] for c in by]
    grouped = s.groupingSets(sets, "run_id", *by).agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in by],
        F.count(F.lit(1)).alias("tasks"),
        F.count_if("passed").alias("passed"),
        F.avg("score").alias("accuracy"),
        F.avg("row_f1").alias("avg_row_f1"),
    )
    attribute = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in by])
    value = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c)) for c in by])
    return grouped.select(
        "run_id",
        attribute.alias("attribute"),
        value.alias("value"),
        "tasks",
        "passed",
        "accuracy",
        "avg_row_f1",
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """One row per run: totals, rates, averages and flag counts."""
    ok = F.col("passed").isNotNull()
    native = F.col("passed") & ~F.col("sql_transpiled")
    total, passed = F.count_if(ok), F.count_if("passed")
    only = lambda c: F.when(ok, F.col(c))
    return scores.groupBy("run_id").agg(
        total.alias("tasks_total"),
        passed.alias("tasks_passed"),
        (total - passed).alias("tasks_failed"),
        ratio(passed, total).alias("task_success_rate"),
        F.count_if(native).alias("tasks_passed_native"),
        ratio(F.count_if(native), total).alias("task_success_rate_native"),
        F.count_if(ok & F.col("sql_transpiled")).alias("transpiled_count"),
        F.count_if(ok & F.col("extra_columns_relaxed")).alias("extra_columns_relaxed_count"),
        F.count_if(ok & F.col("empty_set_relaxed")).alias("empty_set_relaxed_count"),
        F.count_if(~ok).alias("rubric_pending_count"),
        mean_or_zero(only("score")).alias("macro_score"),
        *[
            mean_or_zero(only(c)).alias(f"avg_{c}")
            for c in ("row_f1", "precision", "recall", "column_match", "latency_seconds", "cost_usd")
        ],
        F.coalesce(F.sum(only("cost_usd")), F.lit(0.0)).alias("total_cost_usd"),
    )


def error_counts(scores: DataFrame, per_run: bool = True) -> DataFrame:
    keys = ["run_id"] if per_run else []
    return (
        scorable(scores)
        .select(*keys, error_of().alias("error"))
        .where(F.col("error").isNotNull())
        .groupBy(*keys, "error")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def failed_tasks(scores: DataFrame) -> DataFrame:
    return scores.where(~F.col("passed")).select("run_id", "task_id")


def native_vs_fallback(scores: DataFrame) -> DataFrame:
    """Pass rate with and without answers that came from a rewritten statement."""
    return score_summary(scores).select(
        "run_id",
        "tasks_total",
        "task_success_rate",
        "task_success_rate_native",
        "transpiled_count",
    )


def session_rollup(turns: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Per session: turns, verdict (all scorable turns passed) and its turns in order.

    The turn list of a session is as long as the conversation itself.
    """
    ok = F.col("passed").isNotNull()
    n_ok, n_pass = F.count_if(ok), F.count_if("passed")
    ordered = F.sort_array(
        F.collect_list(F.struct(F.coalesce("turn_number", F.lit(0)).alias("n"), "task_id"))
    )
    return turns.groupBy(*keys, F.coalesce("session_id", "task_id").alias("session_id")).agg(
        F.count(F.lit(1)).alias("turns_total"),
        n_ok.alias("turns_scorable"),
        n_pass.alias("turns_passed"),
        F.when(n_ok > 0, n_pass == n_ok).alias("session_passed"),
        (F.count(F.lit(1)) > 1).alias("is_multi_turn"),
        F.transform(ordered, lambda t: t["task_id"]).alias("turn_task_ids"),
    )


def session_rates(sessions: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    ok = F.col("session_passed").isNotNull()
    multi = F.col("is_multi_turn")
    total, passed = F.count_if(ok), F.count_if("session_passed")
    m_total, m_passed = F.count_if(ok & multi), F.count_if(multi & F.col("session_passed"))
    t_total = F.coalesce(F.sum(F.when(multi, F.col("turns_scorable"))), F.lit(0))
    t_passed = F.coalesce(F.sum(F.when(multi, F.col("turns_passed"))), F.lit(0))
    return sessions.groupBy(*keys).agg(
        total.alias("sessions_total"),
        passed.alias("sessions_passed"),
        ratio(passed, total).alias("session_success_rate"),
        m_total.alias("multi_turn_sessions_total"),
        m_passed.alias("multi_turn_sessions_passed"),
        ratio(m_passed, m_total).alias("multi_turn_session_success_rate"),
        t_total.alias("multi_turn_turns_total"),
        t_passed.alias("multi_turn_turns_passed"),
        ratio(t_passed, t_total).alias("multi_turn_turn_success_rate"),
    )


def multirun_task(scores: DataFrame, n_runs: int) -> DataFrame:
    """Per task over all runs. A task is outside the rates when every run left it open."""
    scored = F.count("passed") > 0
    passes = F.count_if("passed")
    native = F.count_if(F.col("passed") & ~F.col("sql_transpiled"))
    when = lambda c: F.when(scored, c)
    runs = F.transform(
        F.sort_array(
            F.collect_list(F.struct("run_id", F.coalesce("passed", F.lit(False)).alias("p")))
        ),
        lambda r: r["p"],
    )
    meta = [c for c in ("session_id", "turn_number", *GROUPS) if c in scores.columns]
    return scores.groupBy("task_id").agg(
        *[F.first(c).alias(c) for c in meta],
        when(passes == n_runs).alias("passed"),
        when(passes / n_runs).alias("pass_share"),
        when(native / n_runs).alias("pass_share_native"),
        when(F.when(passes > 0, 1.0).otherwise(0.0)).alias("any_pass"),
        when(passes).alias("passes_out_of_n"),
        runs.alias("run_passes"),
        F.when(scored, F.count_if("sql_transpiled")).otherwise(0).alias("transpiled_runs"),
        *[
            when(F.avg(c)).alias(c)
            for c in ("row_f1", "precision", "recall", "column_match", "latency_seconds", "cost_usd")
        ],
        *[
            F.coalesce(when(F.max(c)), F.lit(False)).alias(c)
            for c in ("extra_columns_relaxed", "empty_set_relaxed")
        ],
        when(F.min("exact_match")).alias("exact_match"),
    )


def representative_error(scores: DataFrame) -> DataFrame:
    """Most frequent error of a task over its runs; the one seen first wins a tie.

    Runs follow each other by number where their ids are numbers, and by text after those.
    """
    number = F.coalesce(F.col("run_id").try_cast("long"), F.lit((1 << 63) - 1))
    counted = (
        scores.where("error_type is not null")
        .groupBy("task_id", "error_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(number, "run_id")).alias("seen"))
    )
    best = F.min_by("error_type", F.struct((-F.col("n")).alias("n"), "seen"))
    return counted.groupBy("task_id").agg(best.alias("error_type"))


def multirun_headline(tasks: DataFrame) -> DataFrame:
    """``mean_pass_share`` and ``all_pass_rate`` are different numbers and keep separate names."""
    ok = F.col("pass_share").isNotNull()
    total = F.count_if(ok)
    return tasks.agg(
        total.alias("tasks_total"),
        F.count_if("passed").alias("tasks_passed"),
        (total - F.count_if("passed")).alias("tasks_failed"),
        mean_or_zero("pass_share").alias("mean_pass_share"),
        mean_or_zero("pass_share_native").alias("mean_pass_share_native"),
        mean_or_zero("any_pass").alias("mean_any_pass"),
        ratio(F.count_if("passed"), total).alias("all_pass_rate"),
        F.count_if(ok & (F.col("transpiled_runs") > 0)).alias("transpiled_count"),
        F.count_if(~ok).alias("rubric_pending_count"),
        F.count_if(F.col("any_pass") == 0.0).alias("never_solved"),
    )


def per_run_rates(scores: DataFrame) -> DataFrame:
    ok = scorable(scores)
    return ok.groupBy("run_id").agg(
        F.round(F.count_if("passed") / F.count(F.lit(1)), 6).alias("task_success_rate"),
        F.count_if("sql_transpiled").alias("transpiled"),
    )


def multirun_groups(tasks: DataFrame, by: tuple[str, ...] = GROUPS) -> DataFrame:
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in by]
    s = tasks.where("pass_share is not null").select(
        *keys, "pass_share", "any_pass", "row_f1", "passed"
    )
    grouped = s.groupingSets([[F.col(c)] for c in by], *by).agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in by],
        F.count(F.lit(1)).alias("tasks"),
        F.count_if("passed").alias("passed"),
        F.avg("pass_share").alias("accuracy"),
        F.avg("any_pass").alias("any_pass"),
        F.avg("row_f1").alias("avg_row_f1"),
    )
    pick = lambda f: F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, f(c)) for c in by])
    return grouped.select(
        pick(F.lit).alias("attribute"),
        pick(F.col).alias("value"),
        "tasks",
        "passed",
        "accuracy",
        "any_pass",
        "avg_row_f1",
    )


def churn(tasks: DataFrame) -> DataFrame:
    """Tasks whose verdict differs between runs of the same system."""
    changed = (F.col("any_pass") == 1.0) & ~F.col("passed")
    total = F.count_if(F.col("pass_share").isNotNull())
    return tasks.agg(
        total.alias("tasks"),
        F.count_if(changed).alias("changed"),
        ratio(F.count_if(changed), total).alias("share"),
    )


def run_mean_std(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample standard deviation over runs."""
    return values.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )


def single_turn_rate(ex: Column, multi: Column, n_all: int, n_multi: int) -> Column:
    """Single-turn rate implied by the overall and the multi-turn rate."""
    return (n_all * ex - n_multi * multi) / (n_all - n_multi)


def metered_cost(meter: DataFrame, keys: list[str], rate: float, correct: Column) -> DataFrame:
    """Cost per attempt and per correct answer from metered units."""
    units = F.sum("units") * F.lit(rate)
    return meter.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum("units").alias("units"),
        (units / F.count(F.lit(1))).alias("cost_per_attempt"),
        F.when(F.count_if(correct) > 0, units / F.count_if(correct)).alias("cost_per_correct"),
    )


def outage(tokens: Column, cost: Column, error: Column) -> Column:
    """A failed attempt that used nothing was an outage, not an answer."""
    return (tokens == 0) & (cost == 0) & error.isNotNull()


def meter_reconciliation(attempts: DataFrame, meter: DataFrame, keys: list[str]) -> DataFrame:
    """Billed events against logged attempts per kind; the unexplained rest should be 0."""
    log = attempts.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "first").alias("first_attempts"),
        F.count_if(F.col("kind") == "retry").alias("retries"),
        F.count_if(F.col("kind") == "exhausted").alias("exhausted"),
        F.count_if(F.col("kind") == "extra").alias("extras"),
    )
    billed = meter.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("billed"), F.sum("units").alias("units")
    )
    zero = F.lit(0).cast("long")
    parts = [F.coalesce(c, zero) for c in ("first_attempts", "retries", "exhausted", "extras")]
    return billed.join(log, keys, "full_outer").select(
        *keys,
        F.coalesce("billed", zero).alias("billed"),
        *[p.alias(n) for p, n in zip(parts, ("first_attempts", "retries", "exhausted", "extras"))],
        (F.coalesce("billed", zero) - sum(parts[1:], parts[0])).alias("unexplained"),
        F.when(F.col("billed") > 0, F.col("units") / F.col("billed")).alias("unit_price"),
        F.when(F.col("billed") > 0, (parts[1] + parts[2]) / F.col("billed")).alias("retry_share"),
    )
