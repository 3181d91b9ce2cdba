"""Roll-up queries over scores of three runs derived from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import rollup as U
from assayer.operators.ordering import quantiles
from assayer.plans.registry import query
from assayer.session import table

N_RUNS = 3


def scores(spark, sf):
    """One score per (run, turn): verdict and metrics follow from conversation, turn and run."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.explode(F.array(*[F.lit(r) for r in range(N_RUNS)])).alias("run")
    )
    h = (F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("run") * 5) % 4
    k = (F.col("conv_id") + F.col("turn") + F.col("run")) % 5
    system = F.col("role") == "system"
    # every fifth conversation fails in all runs
    passed = F.when(~system, (h != 0) & (F.col("conv_id") % 5 != 3))
    error = F.when(system, "rubric_pending").when(
        (h == 0) & (k == 0), "empty_prediction"
    ).when((h == 0) & (k == 1), "format_error")
    return c.select(
        F.col("run").cast("string").alias("run_id"),
        F.concat_ws("_", "conv_id", "turn").alias("task_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").cast("int").alias("turn_number"),
        passed.alias("passed"),
        passed.cast("double").alias("score"),
        F.coalesce(passed, F.lit(False)).alias("exact_match"),
        (k / 4).alias("row_f1"),
        (h / 4).alias("precision"),
        ((4 - h) / 4).alias("recall"),
        (k / 8).alias("column_match"),
        error.alias("error_type"),
        F.lit("Rows").alias("scoring_method"),
        F.when(F.col("turn") % 2 == 0, "Scalar").otherwise("Rows").alias("answer_type"),
        (F.col("conv_id") % 8 + 1).cast("int").alias("tier"),
        F.when(F.col("turn") % 3 == 0, "Simple").when(F.col("turn") % 3 == 1, "Medium").alias(
            "sql_difficulty"
        ),
        F.when(F.col("conv_id") % 2 == 0, "Schema").otherwise("Data").alias("primary_axis"),
        F.when(k < 4, F.length("role") * 0.5 + k).alias("latency_seconds"),
        F.when(h < 3, (h + 1) / 8).alias("cost_usd"),
        ((F.col("conv_id") + F.col("run")) % 6 == 0).alias("sql_transpiled"),
        ((h == 1) & (k == 2)).alias("extra_columns_relaxed"),
        ((h == 2) & (k == 3)).alias("empty_set_relaxed"),
    )


SCORES = """
WITH b AS (
    SELECT *, (conv_id * 7 + turn * 3 + run * 5) % 4 AS h, (conv_id + turn + run) % 5 AS k
    FROM conversations, (VALUES (0), (1), (2)) r(run)),
s AS (
    SELECT run::VARCHAR AS run_id, conv_id || '_' || turn AS task_id, conv_id::VARCHAR AS session_id, turn,
           CASE WHEN role <> 'system' THEN h <> 0 AND conv_id % 5 <> 3 END AS passed, k / 4 AS row_f1, h / 4 AS precision,
           (4 - h) / 4 AS recall, k / 8 AS column_match,
           CASE WHEN role = 'system' THEN 'rubric_pending' WHEN h = 0 AND k = 0 THEN 'empty_prediction'
                WHEN h = 0 AND k = 1 THEN 'format_error' END AS error_type,
           CASE WHEN turn % 2 = 0 THEN 'Scalar' ELSE 'Rows' END AS answer_type,
           (conv_id % 8 + 1)::VARCHAR AS tier,
           CASE turn % 3 WHEN 0 THEN 'Simple' WHEN 1 THEN 'Medium' ELSE 'null' END AS sql_difficulty,
           CASE WHEN conv_id % 2 = 0 THEN 'Schema' ELSE 'Data' END AS primary_axis,
           CASE WHEN k < 4 THEN length(role) * 0.5 + k END AS latency, CASE WHEN h < 3 THEN (h + 1) / 8 END AS cost,
           (conv_id + run) % 6 = 0 AS rewritten, h = 1 AND k = 2 AS wider, h = 2 AND k = 3 AS zeroed
    FROM b),
t AS (
    SELECT task_id, any_value(session_id) AS session_id, any_value(turn) AS turn, any_value(tier) AS tier,
           any_value(sql_difficulty) AS sql_difficulty, any_value(primary_axis) AS primary_axis,
           any_value(answer_type) AS answer_type, count(passed) > 0 AS ok,
           count(*) FILTER (WHERE passed) AS passes, count(*) FILTER (WHERE passed AND NOT rewritten) AS native,
           count(*) FILTER (WHERE rewritten) AS rewritten, avg(row_f1) AS row_f1, avg(precision) AS precision,
           avg(latency) AS latency, avg(cost) AS cost, bool_or(wider) AS wider
    FROM s GROUP BY task_id),
e AS (
    SELECT *, coalesce(error_type, CASE WHEN NOT passed THEN 'answer_mismatch' END) AS error
    FROM s WHERE passed IS NOT NULL)
"""

SESSION_FIELDS = """
    count(*) FILTER (WHERE sp IS NOT NULL)::BIGINT AS sessions_total,
    count(*) FILTER (WHERE sp)::BIGINT AS sessions_passed,
    coalesce(count(*) FILTER (WHERE sp) / nullif(count(*) FILTER (WHERE sp IS NOT NULL), 0), 0.0) AS session_success_rate,
    count(*) FILTER (WHERE sp IS NOT NULL AND tt > 1)::BIGINT AS multi_turn_sessions_total,
    count(*) FILTER (WHERE sp AND tt > 1)::BIGINT AS multi_turn_sessions_passed,
    coalesce(count(*) FILTER (WHERE sp AND tt > 1) / nullif(count(*) FILTER (WHERE sp IS NOT NULL AND tt > 1), 0), 0.0)
        AS multi_turn_session_success_rate,
    coalesce(sum(ts) FILTER (WHERE tt > 1), 0)::BIGINT AS multi_turn_turns_total,
    coalesce(sum(tp) FILTER (WHERE tt > 1), 0)::BIGINT AS multi_turn_turns_passed,
    coalesce(sum(tp) FILTER (WHERE tt > 1) / nullif(sum(ts) FILTER (WHERE tt > 1), 0), 0.0) AS multi_turn_turn_success_rate
"""


def _grouped(attribute: str) -> str:
    return (
        f"SELECT run_id, '{attribute}' AS attribute, {attribute} AS value, count(*)::BIGINT AS tasks, "
        "count(*) FILTER (WHERE passed)::BIGINT AS passed, avg(passed::INT) AS accuracy, "
        f"avg(row_f1) AS avg_row_f1 FROM s WHERE passed IS NOT NULL GROUP BY run_id, {attribute}"
    )


def _rounded(df, *columns, places=8):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("group_accuracy", SCORES + " UNION ALL ".join(_grouped(a) for a in U.GROUPS))
def group_accuracy(spark, sf):
    return U.group_accuracy(scores(spark, sf))


@query(
    "score_summary",
    SCORES
    + """
    SELECT run_id, count(passed)::BIGINT AS tasks_total, count(*) FILTER (WHERE passed)::BIGINT AS tasks_passed,
           count(*) FILTER (WHERE NOT passed)::BIGINT AS tasks_failed,
           count(*) FILTER (WHERE passed) / count(passed) AS task_success_rate,
           count(*) FILTER (WHERE passed AND NOT rewritten)::BIGINT AS tasks_passed_native,
           count(*) FILTER (WHERE passed AND NOT rewritten) / count(passed) AS task_success_rate_native,
           count(*) FILTER (WHERE passed IS NOT NULL AND rewritten)::BIGINT AS transpiled_count,
           count(*) FILTER (WHERE passed IS NOT NULL AND wider)::BIGINT AS extra_columns_relaxed_count,
           count(*) FILTER (WHERE passed IS NOT NULL AND zeroed)::BIGINT AS empty_set_relaxed_count,
           count(*) FILTER (WHERE passed IS NULL)::BIGINT AS rubric_pending_count,
           avg(passed::INT) AS macro_score,
           round(avg(row_f1) FILTER (WHERE passed IS NOT NULL), 8) AS avg_row_f1,
           round(avg(precision) FILTER (WHERE passed IS NOT NULL), 8) AS avg_precision,
           round(avg(recall) FILTER (WHERE passed IS NOT NULL), 8) AS avg_recall,
           round(avg(column_match) FILTER (WHERE passed IS NOT NULL), 8) AS avg_column_match,
           round(avg(latency) FILTER (WHERE passed IS NOT NULL), 8) AS avg_latency_seconds,
           round(avg(cost) FILTER (WHERE passed IS NOT NULL), 8) AS avg_cost_usd,
           round(sum(cost) FILTER (WHERE passed IS NOT NULL), 8) AS total_cost_usd
    FROM s GROUP BY run_id
    """,
)
def score_summary(spark, sf):
    df = U.score_summary(scores(spark, sf))
    return _rounded(df, *[c for c in df.columns if c.startswith("avg_") or c == "total_cost_usd"])


@query("error_counts", SCORES + "SELECT run_id, error, count(*)::BIGINT AS n FROM e WHERE error IS NOT NULL GROUP BY ALL")
def error_counts(spark, sf):
    return U.error_counts(scores(spark, sf))


@query("failed_tasks", SCORES + "SELECT run_id, task_id FROM s WHERE NOT passed")
def failed_tasks(spark, sf):
    return U.failed_tasks(scores(spark, sf))


@query(
    "native_vs_fallback",
    SCORES
    + """
    SELECT run_id, count(passed)::BIGINT AS tasks_total, count(*) FILTER (WHERE passed) / count(passed) AS task_success_rate,
           count(*) FILTER (WHERE passed AND NOT rewritten) / count(passed) AS task_success_rate_native,
           count(*) FILTER (WHERE passed IS NOT NULL AND rewritten)::BIGINT AS transpiled_count
    FROM s GROUP BY run_id
    """,
)
def native_vs_fallback(spark, sf):
    return U.native_vs_fallback(scores(spark, sf))


SESSIONS = """,
x AS (
    SELECT run_id, session_id, count(*) AS tt, count(passed) AS ts, count(*) FILTER (WHERE passed) AS tp,
           CASE WHEN count(passed) > 0 THEN count(*) FILTER (WHERE passed) = count(passed) END AS sp,
           string_agg(task_id, ',' ORDER BY turn) AS turns
    FROM s GROUP BY ALL)
"""


@query(
    "session_rollup",
    SCORES
    + SESSIONS
    + """
    SELECT run_id, session_id, tt AS turns_total, ts AS turns_scorable, tp AS turns_passed, sp AS session_passed,
           tt > 1 AS is_multi_turn, turns AS turn_task_ids FROM x
    """,
)
def session_rollup(spark, sf):
    out = U.session_rollup(scores(spark, sf))
    return out.withColumn("turn_task_ids", F.array_join("turn_task_ids", ","))


@query("session_rates", SCORES + SESSIONS + f"SELECT run_id, {SESSION_FIELDS} FROM x GROUP BY run_id")
def session_rates(spark, sf):
    return U.session_rates(U.session_rollup(scores(spark, sf)))


@query(
    "multirun_task",
    SCORES
    + """,
    r AS (SELECT task_id, string_agg(coalesce(passed, false)::VARCHAR, ',' ORDER BY run_id) AS run_passes FROM s GROUP BY 1)
    SELECT task_id, session_id, CASE WHEN ok THEN passes = 3 END AS passed, CASE WHEN ok THEN round(passes / 3, 8) END AS pass_share,
           CASE WHEN ok THEN round(native / 3, 8) END AS pass_share_native, CASE WHEN ok THEN (passes > 0)::INT::DOUBLE END AS any_pass,
           CASE WHEN ok THEN passes END AS passes_out_of_n, run_passes, CASE WHEN ok THEN rewritten ELSE 0 END AS transpiled_runs,
           CASE WHEN ok THEN round(row_f1, 8) END AS row_f1, CASE WHEN ok THEN round(latency, 8) END AS latency_seconds,
           CASE WHEN ok THEN round(cost, 8) END AS cost_usd, ok AND wider AS extra_columns_relaxed
    FROM t JOIN r USING (task_id)
    """,
)
def multirun_task(spark, sf):
    out = U.multirun_task(scores(spark, sf), N_RUNS).select(
        "task_id", "session_id", "passed", "pass_share", "pass_share_native", "any_pass",
        "passes_out_of_n", F.array_join(F.transform("run_passes", lambda p: p.cast("string")), ",").alias("run_passes"),
        "transpiled_runs", "row_f1", "latency_seconds", "cost_usd", "extra_columns_relaxed",
    )
    return _rounded(out, "pass_share", "pass_share_native", "row_f1", "latency_seconds", "cost_usd")


@query(
    "representative_error",
    SCORES
    + """,
    n AS (SELECT task_id, error_type, count(*) AS c, min(run_id) AS seen FROM s WHERE error_type IS NOT NULL GROUP BY ALL)
    SELECT task_id, first(error_type ORDER BY c DESC, seen) AS error_type FROM n GROUP BY task_id
    """,
)
def representative_error(spark, sf):
    return U.representative_error(scores(spark, sf))


@query(
    "multirun_headline",
    SCORES
    + """
    SELECT count(*) FILTER (WHERE ok)::BIGINT AS tasks_total, count(*) FILTER (WHERE ok AND passes = 3)::BIGINT AS tasks_passed,
           count(*) FILTER (WHERE ok AND passes < 3)::BIGINT AS tasks_failed,
           round(avg(passes / 3) FILTER (WHERE ok), 8) AS mean_pass_share, round(avg(native / 3) FILTER (WHERE ok), 8) AS mean_pass_share_native,
           round(avg((passes > 0)::INT) FILTER (WHERE ok), 8) AS mean_any_pass,
           round(count(*) FILTER (WHERE ok AND passes = 3) / count(*) FILTER (WHERE ok), 8) AS all_pass_rate,
           count(*) FILTER (WHERE ok AND rewritten > 0)::BIGINT AS transpiled_count,
           count(*) FILTER (WHERE NOT ok)::BIGINT AS rubric_pending_count,
           count(*) FILTER (WHERE ok AND passes = 0)::BIGINT AS never_solved
    FROM t
    """,
)
def multirun_headline(spark, sf):
    out = U.multirun_headline(U.multirun_task(scores(spark, sf), N_RUNS))
    return _rounded(out, "mean_pass_share", "mean_pass_share_native", "mean_any_pass", "all_pass_rate")


@query(
    "per_run_rates",
    SCORES
    + """
    SELECT run_id, round(avg(passed::INT), 6) AS task_success_rate, count(*) FILTER (WHERE rewritten)::BIGINT AS transpiled
    FROM s WHERE passed IS NOT NULL GROUP BY run_id
    """,
)
def per_run_rates(spark, sf):
    return U.per_run_rates(scores(spark, sf))


def _multi_grouped(attribute: str) -> str:
    return (
        f"SELECT '{attribute}' AS attribute, {attribute} AS value, count(*)::BIGINT AS tasks, "
        "count(*) FILTER (WHERE passes = 3)::BIGINT AS passed, round(avg(passes / 3), 8) AS accuracy, "
        "round(avg((passes > 0)::INT), 8) AS any_pass, round(avg(row_f1), 8) AS avg_row_f1 "
        f"FROM t WHERE ok GROUP BY {attribute}"
    )


@query("multirun_groups", SCORES + " UNION ALL ".join(_multi_grouped(a) for a in U.GROUPS))
def multirun_groups(spark, sf):
    out = U.multirun_groups(U.multirun_task(scores(spark, sf), N_RUNS))
    return _rounded(out, "accuracy", "any_pass", "avg_row_f1")


@query(
    "multirun_sessions",
    SCORES
    + f""",
    x AS (SELECT session_id, count(*) AS tt, count(*) FILTER (WHERE ok) AS ts, count(*) FILTER (WHERE ok AND passes = 3) AS tp,
                 CASE WHEN count(*) FILTER (WHERE ok) > 0
                      THEN count(*) FILTER (WHERE ok AND passes = 3) = count(*) FILTER (WHERE ok) END AS sp
          FROM t GROUP BY session_id)
    SELECT {SESSION_FIELDS} FROM x
    """,
)
def multirun_sessions(spark, sf):
    tasks = U.multirun_task(scores(spark, sf), N_RUNS)
    return U.session_rates(U.session_rollup(tasks, ()), ())


@query("multirun_errors", SCORES + "SELECT error, count(*)::BIGINT AS n FROM e WHERE error IS NOT NULL GROUP BY error")
def multirun_errors(spark, sf):
    return U.error_counts(scores(spark, sf), per_run=False)


@query("never_solved", SCORES + "SELECT task_id FROM t WHERE ok AND passes = 0")
def never_solved(spark, sf):
    tasks = U.multirun_task(scores(spark, sf), N_RUNS)
    return tasks.where("any_pass = 0").select("task_id")


@query(
    "churn",
    SCORES
    + """
    SELECT count(*) FILTER (WHERE ok)::BIGINT AS tasks, count(*) FILTER (WHERE ok AND passes BETWEEN 1 AND 2)::BIGINT AS changed,
           count(*) FILTER (WHERE ok AND passes BETWEEN 1 AND 2) / count(*) FILTER (WHERE ok) AS share FROM t
    """,
)
def churn(spark, sf):
    return U.churn(U.multirun_task(scores(spark, sf), N_RUNS))


@query(
    "run_mean_std",
    SCORES
    + """,
    r AS (SELECT tier, run_id, avg(passed::INT) AS rate FROM s WHERE passed IS NOT NULL GROUP BY ALL)
    SELECT tier, round(avg(rate), 8) AS mean, round(stddev_samp(rate), 8) AS std, count(rate)::BIGINT AS n FROM r GROUP BY tier
    """,
)
def run_mean_std(spark, sf):
    rates = (
        U.scorable(scores(spark, sf))
        .groupBy(F.col("tier").cast("string").alias("tier"), "run_id")
        .agg(F.avg("score").alias("rate"))
    )
    return _rounded(U.run_mean_std(rates, ["tier"], "rate"), "mean", "std")


@query(
    "single_turn_identity",
    SCORES
    + """
    SELECT run_id, count(*)::BIGINT AS n_all, count(*) FILTER (WHERE turn > 0)::BIGINT AS n_multi,
           round(avg(passed::INT) FILTER (WHERE turn = 0), 8) AS implied, true AS agrees
    FROM s WHERE passed IS NOT NULL GROUP BY run_id
    """,
)
def single_turn_identity(spark, sf):
    """First turns play the single-turn part, later turns the multi-turn part."""
    later = F.col("turn_number") > 0
    r = (
        U.scorable(scores(spark, sf))
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("n_all"),
            F.count_if(later).alias("n_multi"),
            F.avg("score").alias("ex"),
            F.avg(F.when(later, F.col("score"))).alias("mt"),
            F.avg(F.when(~later, F.col("score"))).alias("direct"),
        )
    )
    implied = U.single_turn_rate(F.col("ex"), F.col("mt"), F.col("n_all"), F.col("n_multi"))
    return r.select(
        "run_id",
        "n_all",
        "n_multi",
        F.round(implied, 8).alias("implied"),
        (F.abs(implied - F.col("direct")) < 1e-9).alias("agrees"),
    )


@query(
    "tier_recombination",
    SCORES
    + """
    SELECT count(*)::BIGINT AS tasks, count(*) FILTER (WHERE passes = 3)::BIGINT AS all_pass,
           count(*) FILTER (WHERE passes = 3)::BIGINT AS recombined FROM t WHERE ok
    """,
)
def tier_recombination(spark, sf):
    """Tier rates times tier sizes add up to the all-pass count."""
    tasks = U.multirun_task(scores(spark, sf), N_RUNS).where("pass_share is not null")
    tiers = tasks.groupBy("tier").agg(
        F.count(F.lit(1)).alias("size"), F.count_if("passed").alias("n")
    )
    rates = tiers.withColumn("rate", F.round(F.col("n") / F.col("size"), 6))
    return rates.agg(
        F.sum("size").alias("tasks"),
        F.sum("n").alias("all_pass"),
        F.sum(F.round(F.col("rate") * F.col("size"))).cast("long").alias("recombined"),
    )


def _meter(spark, sf):
    """Every event is a metered call: its type is the channel, its value the units."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("channel"),
        F.col("ts").cast("date").alias("day"),
        F.col("value").cast("decimal(18,4)").alias("units"),
        (F.col("user_id") % 3 == 0).alias("correct"),
        F.when(F.col("event_id") % 10 == 0, "retry")
        .when(F.col("event_id") % 10 == 1, "exhausted")
        .when(F.col("event_id") % 50 == 2, "extra")
        .otherwise("first")
        .alias("kind"),
    )


@query(
    "metered_cost",
    """
    SELECT event_type AS channel, count(*)::BIGINT AS attempts, sum(value::DECIMAL(18,4))::DOUBLE AS units,
           round(sum(value::DECIMAL(18,4))::DOUBLE * 0.7 / count(*), 6) AS cost_per_attempt,
           round(sum(value::DECIMAL(18,4))::DOUBLE * 0.7 / count(*) FILTER (WHERE user_id % 3 = 0), 6) AS cost_per_correct
    FROM events WHERE event_type <> 'error' GROUP BY 1
    """,
)
def metered_cost(spark, sf):
    meter = _meter(spark, sf).where("channel <> 'error'")
    out = U.metered_cost(meter, ["channel"], 0.7, F.col("correct"))
    return _rounded(
        out.withColumn("units", F.col("units").cast("double")), "cost_per_attempt", "cost_per_correct", places=6
    )


@query(
    "infra_failure_filter",
    """
    SELECT user_id % 3 AS run, count(*)::BIGINT AS attempts,
           count(*) FILTER (WHERE event_type = 'error' AND event_id % 4 = 0)::BIGINT AS purged
    FROM events GROUP BY 1
    """,
)
def infra_failure_filter(spark, sf):
    idle = F.col("event_id") % 4 == 0
    tokens = F.when(idle, 0).otherwise(F.length("props"))
    cost = F.when(idle, 0.0).otherwise(F.col("value") + 1)
    error = F.when(F.col("event_type") == "error", "failed")
    return (
        table(spark, sf, "events")
        .select((F.col("user_id") % 3).alias("run"), U.outage(tokens, cost, error).alias("out"))
        .groupBy("run")
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_if("out").alias("purged"))
    )


@query(
    "meter_reconciliation",
    """
    WITH m AS (
        SELECT *, ts::DATE AS day, CASE WHEN event_id % 10 = 0 THEN 'retry' WHEN event_id % 10 = 1 THEN 'exhausted'
                  WHEN event_id % 50 = 2 THEN 'extra' ELSE 'first' END AS kind FROM events)
    SELECT day, count(*)::BIGINT AS billed, count(*) FILTER (WHERE kind = 'first')::BIGINT AS first_attempts,
           count(*) FILTER (WHERE kind = 'retry')::BIGINT AS retries,
           count(*) FILTER (WHERE kind = 'exhausted')::BIGINT AS exhausted,
           count(*) FILTER (WHERE kind = 'extra' AND event_id % 100 <> 2)::BIGINT AS extras,
           count(*) FILTER (WHERE kind = 'extra' AND event_id % 100 = 2)::BIGINT AS unexplained,
           round(sum(value::DECIMAL(18,4))::DOUBLE / count(*), 6) AS unit_price,
           round(count(*) FILTER (WHERE kind IN ('retry', 'exhausted')) / count(*), 8) AS retry_share
    FROM m GROUP BY day
    """,
)
def meter_reconciliation(spark, sf):
    """Half of the extra calls were never logged: they stay unexplained."""
    meter = _meter(spark, sf)
    out = U.meter_reconciliation(meter.where("event_id % 100 <> 2"), meter, ["day"])
    out = out.withColumn("unit_price", F.col("unit_price").cast("double"))
    return _rounded(_rounded(out, "unit_price", places=6), "retry_share")


@query(
    "median_latency",
    """
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median_value, count(*)::BIGINT AS n
    FROM events GROUP BY event_type
    """,
)
def median_latency(spark, sf):
    """Exact median, whatever the number of values of a type."""
    out = quantiles(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", {"median_value": 0.5})
    return out.withColumn("median_value", F.round("median_value", 6))


def _verdicts(spark, sf, shift):
    return scores(spark, sf).select(
        "run_id",
        "task_id",
        F.when(
            (F.col("turn_number") == shift) & (F.col("tier") == 3), F.lit(True)
        ).otherwise(F.col("passed")).alias("passed"),
    )


@query(
    "verdict_diff",
    SCORES
    + """
    SELECT coalesce(passed::VARCHAR, 'none') AS before, 'true' AS after, count(*)::BIGINT AS n
    FROM s WHERE turn = 1 AND tier = '3' AND (passed IS NULL OR NOT passed) GROUP BY 1
    """,
)
def verdict_diff(spark, sf):
    """Verdicts that moved between two scorings of the same runs."""
    from assayer.operators.audit import verdict_diff as diff

    return diff(_verdicts(spark, sf, -1), _verdicts(spark, sf, 1))
