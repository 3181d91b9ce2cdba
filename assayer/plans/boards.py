"""Board and entry-rule queries: every supplier is a system, its order lines are its tasks.

A line passes run r unless (part + r) mod 4 is 0; it passes all three runs when part mod 4 is 1.
Tiers are part mod 8 + 1, sessions are line numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import board as B
from assayer.operators import rules as R
from assayer.plans.registry import query
from assayer.session import table

TIERS = [str(t) for t in range(1, 9)]
SESSIONS = [f"S{n}" for n in range(1, 8)]


def entries(spark, sf):
    """Nested entry rows; partial counts per (supplier, tier, session) are grouped first."""
    line = table(spark, sf, "lineitem").select(
        "l_suppkey",
        "l_partkey",
        (F.col("l_partkey") % 8 + 1).cast("string").alias("tier"),
        F.concat(F.lit("S"), "l_linenumber").alias("session"),
        F.col("l_quantity").cast("decimal(18,2)").alias("q"),
    )
    ok = lambda r: F.count_if((F.col("l_partkey") + r) % 4 != 0)
    part = line.groupBy("l_suppkey", "tier", "session").agg(
        F.count(F.lit(1)).alias("n"),
        *[ok(r).alias(f"p{r}") for r in range(3)],
        F.count_if(F.col("l_partkey") % 4 == 1).alias("all"),
        F.sum("q").alias("q"),
    )
    # at most tiers x sessions rows per supplier from here on
    tiers = (
        part.groupBy("l_suppkey", "tier")
        .agg((F.sum("all") / F.sum("n")).alias("rate"))
        .groupBy("l_suppkey")
        .agg(F.map_from_entries(F.collect_list(F.struct("tier", F.round("rate", 4)))).alias("by_tier"))
    )
    sessions = (
        part.groupBy("l_suppkey", "session")
        .agg(
            F.struct(
                F.sum("all").alias("turns_passed"),
                F.sum("n").alias("turns_total"),
                (F.sum("all") == F.sum("n")).alias("session_passed"),
            ).alias("s")
        )
        .groupBy("l_suppkey")
        .agg(F.map_from_entries(F.collect_list(F.struct("session", "s"))).alias("by_session"))
    )
    total = part.groupBy("l_suppkey").agg(
        *[F.sum(c).alias(c) for c in ("n", "p0", "p1", "p2", "all", "q")]
    )
    k = F.col("s_suppkey")
    runs = F.array(*[F.round(F.col(f"p{r}") / F.col("n"), 6) for r in range(3)])
    no = lambda t: F.lit(None).cast(t)
    lost = k % 13 == 0
    free = k % 9 == 0
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    joined = (
        s.join(total, F.col("s_suppkey") == F.col("l_suppkey"))
        .drop("l_suppkey")
        .join(tiers.withColumnRenamed("l_suppkey", "s_suppkey"), "s_suppkey")
        .join(sessions.withColumnRenamed("l_suppkey", "s_suppkey"), "s_suppkey")
        .withColumn("runs", runs)
    )
    return joined.select(
        F.concat(F.lit("2026-01-15-s"), k.cast("string")).alias("entry_id"),
        F.struct(
            F.col("s_name").alias("name"),
            F.lit("supplier").alias("organization"),
            (k % 2 == 0).alias("open_source"),
            F.when(k % 11 == 0, "reference").otherwise("agent").alias("kind"),
            F.when(k % 2 == 0, "controlled").otherwise("commercial").alias("arm"),
        ).alias("system"),
        F.struct(F.lit("m").alias("name"), F.lit("api").alias("access")).alias("model"),
        F.struct(
            F.lit("full").alias("split"),
            F.lit("v1").alias("corpus_version"),
            F.when(k % 7 == 0, "snap_v1.1_2026").otherwise("snap_v1.3_2026").alias("data_snapshot_id"),
            F.lit("v1").alias("scorer_version"),
            F.lit(3).alias("runs"),
            F.col("n").alias("denominator"),
            F.when(k % 5 == 0, F.col("n") - 1).otherwise(F.col("n")).alias("attempted"),
            F.lit("2026-01-15T00:00:00Z").alias("evaluated_at"),
        ).alias("protocol"),
        F.struct(
            F.struct(
                F.round(R.run_mean(F.col("runs")), 6).alias("mean"),
                F.round(R.run_std(F.col("runs")), 6).alias("std"),
                F.col("runs").alias("runs"),
            ).alias("execution_accuracy"),
            F.struct(
                F.when(~lost, F.round(F.col("all") / F.col("n"), 6)).alias("mean"),
                F.when(lost, "not measured").alias("unavailable_reason"),
            ).alias("pass_all"),
            F.struct(
                F.when(~free, F.round(F.col("q").cast("double") / F.col("n") / 100, 6)).alias("mean"),
                F.when(free, "not metered").alias("unavailable_reason"),
            ).alias("cost_usd_per_task"),
            F.struct(
                F.when(k % 4 != 0, F.round(F.col("q").cast("double") / F.col("n"), 4)).alias("mean"),
                F.when(k % 4 == 0, "not timed").alias("unavailable_reason"),
            ).alias("median_latency_s"),
            F.col("by_tier"),
            F.col("by_session"),
        ).alias("results"),
        F.struct(F.lit(False).alias("test_data_seen"), F.lit(False).alias("human_in_loop")).alias(
            "declarations"
        ),
        k.alias("key"),
    )


ENTRIES = """
WITH l AS (
    SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (WHERE l_partkey % 4 <> 0) AS p0,
           count(*) FILTER (WHERE (l_partkey + 1) % 4 <> 0) AS p1, count(*) FILTER (WHERE (l_partkey + 2) % 4 <> 0) AS p2,
           count(*) FILTER (WHERE l_partkey % 4 = 1) AS a, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) AS q
    FROM lineitem GROUP BY 1),
e AS (
    SELECT k, '2026-01-15-s' || k AS entry_id, n AS denominator, s_name AS system,
           CASE WHEN k % 2 = 0 THEN 'controlled' ELSE 'commercial' END AS arm,
           CASE WHEN k % 11 = 0 THEN 'reference' WHEN k % 7 = 0 THEN 'legacy' ELSE 'measured' END AS band,
           CASE WHEN k % 11 = 0 THEN 0 WHEN k % 7 = 0 THEN 2 ELSE 1 END AS band_order,
           CASE WHEN k % 13 = 0 THEN -1 ELSE round(a / n, 6) END AS rate,
           round((round(p0 / n, 6) + round(p1 / n, 6) + round(p2 / n, 6)) / 3, 6) AS ex,
           CASE WHEN k % 9 <> 0 THEN round(q / 100, 6) END AS cost,
           CASE WHEN k % 4 <> 0 THEN round(q, 4) END AS latency,
           CASE WHEN k % 5 = 0 THEN n - 1 ELSE n END AS attempted
    FROM supplier JOIN l ON s_suppkey = k)
"""


@query("current_snapshot", "SELECT max(CASE WHEN s_suppkey % 7 = 0 THEN 'snap_v1.1_2026' ELSE 'snap_v1.3_2026' END) AS snapshot FROM supplier")
def current_snapshot(spark, sf):
    return B.current_snapshot(entries(spark, sf))


@query("band", ENTRIES + "SELECT band, count(*)::BIGINT AS n FROM e GROUP BY band")
def band(spark, sf):
    return B.banded(entries(spark, sf)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("metric_extract", ENTRIES + "SELECT entry_id, rate, ex AS execution_accuracy, cost, latency FROM e")
def metric_extract(spark, sf):
    return B.banded(entries(spark, sf)).select(
        "entry_id", "rate", "execution_accuracy", "cost", "latency"
    )


@query(
    "dollars_per_correct",
    ENTRIES + "SELECT entry_id, CASE WHEN rate > 0 THEN round(cost / rate, 8) END AS dollars FROM e",
)
def dollars_per_correct(spark, sf):
    e = B.banded(entries(spark, sf))
    dollars = B.dollars_per_correct(F.col("cost"), F.col("rate"))
    return e.select("entry_id", F.round(dollars, 8).alias("dollars"))


@query(
    "board_rank",
    ENTRIES
    + """
    SELECT entry_id, band, rate,
           CASE WHEN band = 'measured' THEN row_number() OVER (PARTITION BY band ORDER BY rate DESC, entry_id) END AS rank
    FROM e
    """,
)
def board_rank(spark, sf):
    return B.board(entries(spark, sf)).select("entry_id", "band", "rate", "rank")


@query(
    "board_order",
    ENTRIES
    + "SELECT entry_id, row_number() OVER (ORDER BY band_order, rate DESC, entry_id) AS position FROM e",
)
def board_order(spark, sf):
    return B.board(entries(spark, sf)).select("entry_id", "position")


@query(
    "leader_flag",
    ENTRIES
    + """
    SELECT entry_id, band = 'measured' AND abs(rate - max(rate) FILTER (WHERE band = 'measured') OVER ()) < 1e-9 AS leader,
           round(100 * greatest(rate, 0) / greatest(max(rate) OVER (), 0.01), 6) AS width
    FROM e
    """,
)
def leader_flag(spark, sf):
    return B.board(entries(spark, sf)).select(
        "entry_id", "leader", F.round("width", 6).alias("width")
    )


@query(
    "rank_by_arm",
    ENTRIES
    + """
    SELECT entry_id, arm, row_number() OVER (PARTITION BY arm ORDER BY rate DESC, entry_id) AS rank
    FROM e WHERE band = 'measured'
    """,
)
def rank_by_arm(spark, sf):
    return B.rank_by_arm(entries(spark, sf)).select("entry_id", "arm", "rank")


@query("undeclared_arms", ENTRIES + "SELECT entry_id FROM e WHERE k % 17 = 3")
def undeclared_arms(spark, sf):
    e = entries(spark, sf)
    spoilt = F.when(F.col("key") % 17 == 3, F.lit("house")).otherwise(F.col("system.arm"))
    return B.undeclared_arms(e.withColumn("system", F.col("system").withField("arm", spoilt))).select("entry_id")


@query(
    "coverage",
    ENTRIES + "SELECT entry_id, attempted, denominator, attempted < denominator AS short FROM e",
)
def coverage(spark, sf):
    return B.board(entries(spark, sf)).select("entry_id", "attempted", "denominator", "short")


@query(
    "tier_pivot",
    """
    WITH t AS (SELECT l_suppkey, l_partkey % 8 + 1 AS tier, round(avg((l_partkey % 4 = 1)::INT), 4) AS rate FROM lineitem GROUP BY ALL)
    SELECT '2026-01-15-s' || l_suppkey AS entry_id, """
    + ", ".join(f"max(rate) FILTER (WHERE tier = {t}) AS T{t}" for t in range(1, 9))
    + " FROM t GROUP BY l_suppkey",
)
def tier_pivot(spark, sf):
    return B.tier_pivot(entries(spark, sf), TIERS)


@query(
    "session_pivot",
    """
    WITH t AS (
        SELECT l_suppkey, l_linenumber AS s, count(*) FILTER (WHERE l_partkey % 4 = 1) AS p, count(*) AS n FROM lineitem GROUP BY ALL),
    c AS (SELECT *, p || '/' || n || CASE WHEN p = n THEN ' *' ELSE '' END AS cell FROM t)
    SELECT '2026-01-15-s' || l_suppkey AS entry_id, """
    + ", ".join(f"max(cell) FILTER (WHERE s = {n}) AS S{n}" for n in range(1, 8))
    + " FROM c GROUP BY l_suppkey",
)
def session_pivot(spark, sf):
    return B.session_pivot(entries(spark, sf), SESSIONS)


@query(
    "session_order",
    "SELECT 'S' || l_linenumber AS session, row_number() OVER (ORDER BY l_linenumber) AS place FROM (SELECT DISTINCT l_linenumber FROM lineitem)",
)
def session_order(spark, sf):
    return B.session_order(entries(spark, sf))


@query(
    "efficiency_rows",
    ENTRIES
    + """
    SELECT entry_id, rate, cost, latency, row_number() OVER (ORDER BY rate DESC, entry_id) AS place
    FROM e WHERE band = 'measured' AND rate > 0 AND (cost IS NOT NULL OR latency IS NOT NULL)
    """,
)
def efficiency_rows(spark, sf):
    return B.efficiency_rows(entries(spark, sf))


@query(
    "board_header",
    ENTRIES
    + """
    SELECT max(denominator)::BIGINT AS denominator,
           CASE WHEN count(DISTINCT attempted) = 1 THEN min(attempted) ELSE max(denominator) END::BIGINT AS attempted,
           3 AS runs, min(entry_id) FILTER (WHERE band = 'reference') AS control_entry,
           count(*) FILTER (WHERE band = 'measured')::BIGINT AS ranked, count(*) FILTER (WHERE band = 'legacy')::BIGINT AS legacy
    FROM e
    """,
)
def board_header(spark, sf):
    return B.header(entries(spark, sf))


# ---------------------------------------------------------------- entry rules

# what is done to the entry of a supplier whose key mod 30 is the number
DEFECTS = {
    1: ('"entry_id":"2026-', '"entry_id":"x026-'),
    2: ('"data_snapshot_id":"snap', '"data_snapshot":"snap'),
    3: ('"split":"full"', '"split":"partial"'),
    4: ('"runs":3', '"runs":0'),
    5: ('"test_data_seen":false', '"test_data_seen":"no"'),
    6: ('"organization":"supplier"', '"organization":"supplier","remark":"x"'),
    7: ('"organization":"supplier"', '"organization":""'),
    8: ('"arm":"co', '"arm":"ho'),
    9: ('"arm":"', '"arms":"'),
    10: ('"name":"m"', '"name":7'),
    11: ('"human_in_loop":false', '"human_in_loop":false,"canary_check":"maybe"'),
    12: ('"human_in_loop":false', '"human_in_loop":false,"canary_check":null'),
    13: ('"by_tier":{"', '"by_tier":{"0":1.75,"'),
    14: ('"pass_all":{"mean"', '"pass_all":{"share"'),
    15: ('"execution_accuracy":{"mean":0.', '"execution_accuracy":{"mean":9.'),
    16: ('"execution_accuracy":{', '"tokens":{"mean":null},"execution_accuracy":{'),
    17: ('"execution_accuracy":{', '"tokens":{"mean":1.0,"runs":[1.0]},"execution_accuracy":{'),
    18: ('"execution_accuracy":{', '"tokens":{"mean":2.0,"std":0.5,"runs":[1.0,2.0,3.0]},"execution_accuracy":{'),
    19: ('"execution_accuracy":{', '"tokens":{"mean":2.0,"runs":[1.0,"2",3.0]},"execution_accuracy":{'),
    20: ('"access":"api"', '"access":"api","temperature":true'),
}


def documents(spark, sf):
    """Entry documents; keys with a listed remainder carry one defect each."""
    doc = F.to_json(
        F.struct("entry_id", "system", "model", "protocol", "results", "declarations")
    )
    base = entries(spark, sf).select("entry_id", "key", doc.alias("doc"))
    spoilt = F.col("doc")
    for n, (old, new) in DEFECTS.items():
        spoilt = F.when(F.col("key") % 30 == n, F.replace(F.col("doc"), F.lit(old), F.lit(new))).otherwise(
            spoilt
        )
    return base.select(F.col("entry_id").alias("row_id"), spoilt.alias("doc"))


def _defects(*rows: str) -> str:
    """Oracle of the expected violations: `remainder | path sql` per row."""
    parts = []
    for r in rows:
        n, path = (x.strip() for x in r.split("|"))
        parts.append(
            f"SELECT '2026-01-15-s' || s_suppkey AS row_id, {path} AS path FROM supplier WHERE s_suppkey % 30 = {n}"
        )
    return " UNION ALL ".join(parts)


def _rule(spark, sf, rule):
    found = R.check_fields(documents(spark, sf), R.ENTRY_FIELDS)
    return found.where(F.col("rule") == rule).select("row_id", "path")


@query("check_type", _defects("5 | 'declarations.test_data_seen'", "10 | 'model.name'", "20 | 'model.temperature'"))
def check_type(spark, sf):
    return _rule(spark, sf, "type")


@query("check_enum", _defects("3 | 'protocol.split'", "8 | 'system.arm'", "11 | 'declarations.canary_check'"))
def check_enum(spark, sf):
    return _rule(spark, sf, "enum")


@query(
    "check_pattern",
    _defects("1 | 'entry_id'", "7 | 'system.organization'"),
)
def check_pattern(spark, sf):
    found = R.check_fields(documents(spark, sf), R.ENTRY_FIELDS)
    return found.where("rule in ('pattern', 'min_length')").select("row_id", "path")


@query("check_range", _defects("4 | 'protocol.runs'", "13 | 'results.by_tier.0'"))
def check_range(spark, sf):
    families = [R.field_rules(R.ENTRY_FIELDS), R.map_value_rules("results.by_tier", ("number",), 0.0, 1.0)]
    found = R.violations(documents(spark, sf), families)
    return found.where("rule = 'minimum' or startswith(path, 'results.by_tier.')").select("row_id", "path")


@query("check_items", _defects("19 | 'results.tokens.runs[1]'"))
def check_items(spark, sf):
    return R.check_items(documents(spark, sf), "results.tokens.runs", ("number", "null")).select(
        "row_id", "path"
    )


@query("check_required", _defects("2 | 'protocol.data_snapshot_id'", "9 | 'system.arm'"))
def check_required(spark, sf):
    return _rule(spark, sf, "required")


@query(
    "check_unexpected",
    _defects("2 | 'protocol.data_snapshot'", "6 | 'system.remark'", "9 | 'system.arms'"),
)
def check_unexpected(spark, sf):
    return R.check_unexpected(documents(spark, sf), R.ENTRY_CLOSED).select("row_id", "path")


@query(
    "check_metric_fields",
    "SELECT '2026-01-15-s' || s_suppkey AS row_id, r.rule FROM supplier, (VALUES ('unexpected'), ('required')) r(rule) "
    "WHERE s_suppkey % 30 = 14 AND s_suppkey % 13 <> 0 ",
)
def check_metric_fields(spark, sf):
    found = R.check_objects(
        documents(spark, sf), "results", R.METRIC_RULES, ("by_tier", "by_session")
    )
    renamed = documents(spark, sf).where(F.col("doc").contains('"share"')).select("row_id")
    return (
        found.where(F.col("path").startswith("results.pass_all"))
        .join(renamed, "row_id", "left_semi")
        .select("row_id", "rule")
    )


@query("rule_identity", _defects("1 | 'entry_id'"))
def rule_identity(spark, sf):
    docs = documents(spark, sf).withColumn("file", F.concat(F.lit("/r/"), "row_id", F.lit(".json")))
    return R.check_identity(docs, "file").select("row_id", "path")


def _metric_rule(spark, sf, rule, std_too=False):
    found = R.check_metrics(documents(spark, sf), std_too)
    return found.where(F.col("rule") == rule).select("row_id", "path")


@query("rule_mean_of_runs", _defects("15 | 'results.execution_accuracy'"))
def rule_mean_of_runs(spark, sf):
    return _metric_rule(spark, sf, "mean_of_runs")


@query("rule_run_count", _defects("17 | 'results.tokens'", "4 | 'results.execution_accuracy'"))
def rule_run_count(spark, sf):
    return _metric_rule(spark, sf, "run_count")


@query(
    "rule_null_reason",
    _defects("16 | 'results.tokens'")
    + " UNION ALL SELECT '2026-01-15-s' || s_suppkey, 'results.pass_all' FROM supplier WHERE s_suppkey % 30 = 14 AND s_suppkey % 13 <> 0",
)
def rule_null_reason(spark, sf):
    return _metric_rule(spark, sf, "null_reason")


@query("rule_std_of_runs", _defects("18 | 'results.tokens'"))
def rule_std_of_runs(spark, sf):
    return _metric_rule(spark, sf, "std_of_runs", True)
