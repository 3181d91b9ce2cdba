"""Warehouse query families over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import calendar as cal
from assayer.functions import finance as fin
from assayer.operators import families as W
from assayer.operators import temporal as T
from assayer.operators.ordering import quantiles, running_sum
from assayer.plans.registry import query
from assayer.session import table

NET = "l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2))"


def _net():
    return F.col("l_extendedprice").cast("decimal(14,2)") * (
        F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    )


@query(
    "active_in_roles",
    "SELECT count(*)::BIGINT AS n FROM part WHERE p_size <= 30 AND p_type IN ('ECONOMY', 'SMALL')",
)
def active_in_roles(spark, sf):
    return W.active_in_roles(
        table(spark, sf, "part"), F.col("p_size") <= 30, "p_type", ["ECONOMY", "SMALL"]
    )


@query(
    "fy_onboarding_count",
    "SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderdate >= DATE '1996-04-01' AND o_orderdate < DATE '1997-04-01'",
)
def fy_onboarding_count(spark, sf):
    o = table(spark, sf, "orders")
    return o.where(cal.in_fiscal_year(F.col("o_orderdate"), 1996)).agg(F.count(F.lit(1)).alias("n"))


@query(
    "top_advisors",
    """
    SELECT c_name, c_mktsegment, count(*)::BIGINT AS members FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE o_orderstatus = 'O' GROUP BY ALL ORDER BY members DESC, c_name LIMIT 10
    """,
)
def top_advisors(spark, sf):
    members = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_custkey")
    owners = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return W.top_members(members, owners, "o_custkey", "c_custkey", "c_name", 10).select(
        "c_name", "c_mktsegment", "members"
    )


@query(
    "top_k_tiebreak",
    "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey LIMIT 10",
)
def top_k_tiebreak(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return W.top_k(s, F.col("s_nationkey").desc(), F.col("s_suppkey").asc(), 10)


@query(
    "threshold_count",
    "SELECT count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'MACHINERY'",
)
def threshold_count(spark, sf):
    c = table(spark, sf, "customer")
    return c.where("c_acctbal > 5000 and c_mktsegment <> 'MACHINERY'").agg(
        F.count(F.lit(1)).alias("n")
    )


def _customer_orders(spark, sf):
    """Order value and count per nation and segment, summed per customer before the joins."""
    per = (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"),
            F.count(F.lit(1)).alias("orders"),
        )
    )
    n = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf, "customer")
        .join(per, F.col("c_custkey") == F.col("o_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "n_name", "c_mktsegment")
        .agg(F.sum("value").alias("value"), F.sum("orders").alias("orders"))
    )


CUSTOMER_ORDERS = """
WITH v AS (
    SELECT r_name, n_name, c_mktsegment, sum(o_totalprice::DECIMAL(18,2)) AS value, count(*) AS orders
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
"""


@query(
    "segment_rollup",
    CUSTOMER_ORDERS
    + """
,
    g AS (SELECT c_mktsegment, n_name, sum(value) AS value FROM v GROUP BY ALL)
    SELECT c_mktsegment, n_name, value::DOUBLE AS value, rank() OVER (PARTITION BY c_mktsegment ORDER BY value DESC) AS rank FROM g
    """,
)
def segment_rollup(spark, sf):
    per = _customer_orders(spark, sf).groupBy("c_mktsegment", "n_name").agg(F.sum("value").alias("value"))
    out = W.rank_within(per, "c_mktsegment", "value")
    return out.select("c_mktsegment", "n_name", F.col("value").cast("double").alias("value"), "rank")


@query(
    "hierarchy_rollup",
    CUSTOMER_ORDERS
    + """
    SELECT r_name, n_name, c_mktsegment, grouping_id(r_name, n_name, c_mktsegment)::BIGINT AS level,
           sum(value)::DOUBLE AS total, sum(orders)::BIGINT AS orders
    FROM v GROUP BY ROLLUP (r_name, n_name, c_mktsegment)
    """,
)
def hierarchy_rollup(spark, sf):
    v = _customer_orders(spark, sf)
    return v.rollup("r_name", "n_name", "c_mktsegment").agg(
        F.grouping_id().alias("level"),
        F.sum("value").cast("double").alias("total"),
        F.sum("orders").alias("orders"),
    )


@query(
    "management_chain",
    """
    WITH RECURSIVE t AS (
        SELECT s_suppkey, s_name, CASE WHEN s_suppkey = 0 THEN NULL ELSE s_suppkey // 4 END AS boss FROM supplier),
    r AS (
        SELECT s_suppkey, s_name AS chain FROM t WHERE boss IS NULL
        UNION ALL SELECT t.s_suppkey, r.chain || ' > ' || t.s_name FROM t JOIN r ON t.boss = r.s_suppkey)
    SELECT s_suppkey, chain FROM r
    """,
)
def management_chain(spark, sf):
    s = table(spark, sf, "supplier").select(
        "s_suppkey",
        "s_name",
        F.expr("if(s_suppkey = 0, null, s_suppkey div 4)").cast("double").alias("boss"),
    )
    return W.chain_paths(s, "s_suppkey", "boss", "s_name")


GAINS = f"""
WITH g AS (
    SELECT o_custkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days, l_shipdate::DATE AS sold, l_returnflag,
           {NET} - l_quantity::DECIMAL(12,2) * p_retailprice::DECIMAL(12,2) AS gain
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""


def _lots(spark, sf):
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_returnflag", "l_quantity", _net().alias("net")
    )
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    cost = F.col("l_quantity").cast("decimal(12,2)") * F.col("p_retailprice").cast("decimal(12,2)")
    return (
        line.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "o_custkey",
            F.datediff("l_shipdate", "o_orderdate").alias("days"),
            F.col("l_shipdate").cast("date").alias("sold"),
            "l_returnflag",
            (F.col("net") - cost).alias("gain"),
        )
    )


@query(
    "gains_tax_topn",
    GAINS
    + """,
    t AS (SELECT o_custkey, sum(gain) AS gain FROM g WHERE days >= 365 AND sold >= DATE '1997-07-23' GROUP BY 1)
    SELECT o_custkey, gain::DOUBLE AS gain, round(greatest(gain - 125000, 0) * 0.125, 4)::DOUBLE AS tax
    FROM t ORDER BY tax DESC, o_custkey LIMIT 50
    """,
)
def gains_tax_topn(spark, sf):
    lots = _lots(spark, sf).where("days >= 365 and sold >= date'1997-07-23'")
    total = lots.groupBy("o_custkey").agg(F.sum("gain").alias("gain"))
    tax = fin.gains_tax(F.col("gain"), F.lit(125000), F.lit("12.5").cast("decimal(6,2)"))
    taxed = total.select(
        "o_custkey",
        F.col("gain").cast("double").alias("gain"),
        F.round(tax, 4).cast("double").alias("tax"),
    )
    return W.top_k(taxed, F.col("tax").desc(), F.col("o_custkey").asc(), 50)


RULES = """
rules(flag, effective_from, effective_to, threshold, short_pct, long_pct) AS (VALUES
    ('A', DATE '1990-01-01', DATE '1997-12-31', 365, 15.0, 10.0), ('A', DATE '1998-01-01', NULL, 730, 20.0, 12.5),
    ('N', DATE '1990-01-01', DATE '1998-12-31', 365, 30.0, 20.0), ('N', DATE '1999-01-01', NULL, 365, 30.0, 12.5),
    ('R', DATE '1996-01-01', DATE '2000-12-31', 1095, 30.0, 20.0))
"""


def _rules(spark):
    return spark.sql(
        f"WITH {RULES} SELECT flag AS l_returnflag, effective_from, effective_to, threshold, "
        "cast(short_pct as double) AS short_pct, cast(long_pct as double) AS long_pct FROM rules"
    )


@query(
    "rule_range_join",
    f"""
    WITH {RULES}
    SELECT l_returnflag, threshold::BIGINT AS threshold, count(*)::BIGINT AS n
    FROM lineitem LEFT JOIN rules ON flag = l_returnflag AND l_shipdate::DATE >= effective_from
         AND l_shipdate::DATE <= coalesce(effective_to, DATE '9999-12-31')
    GROUP BY ALL
    """,
)
def rule_range_join(spark, sf):
    line = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_shipdate").cast("date").alias("sold")
    )
    # equal (flag, day) pairs meet the rules once
    days = line.groupBy("l_returnflag", "sold").agg(F.count(F.lit(1)).alias("n"))
    met = T.rule_lookup(days, _rules(spark), ["l_returnflag"], "sold")
    return met.groupBy("l_returnflag", F.col("threshold").cast("long").alias("threshold")).agg(
        F.sum("n").alias("n")
    )


@query(
    "holding_term_class",
    GAINS
    + f""", {RULES}
    SELECT l_returnflag, CASE WHEN threshold IS NULL THEN 'none' WHEN days >= threshold THEN 'long' ELSE 'short' END AS term,
           count(*)::BIGINT AS lots, sum(gain)::DOUBLE AS gain
    FROM g LEFT JOIN rules ON flag = l_returnflag AND sold >= effective_from AND sold <= coalesce(effective_to, DATE '9999-12-31')
    WHERE days > 0 GROUP BY ALL
    """,
)
def holding_term_class(spark, sf):
    met = T.rule_lookup(_lots(spark, sf).where("days > 0"), _rules(spark), ["l_returnflag"], "sold")
    term = F.coalesce(
        F.when(F.col("threshold").isNotNull(), fin.term(F.col("days"), F.col("threshold"))),
        F.lit("none"),
    )
    return met.groupBy("l_returnflag", term.alias("term")).agg(
        F.count(F.lit(1)).alias("lots"), F.sum("gain").cast("double").alias("gain")
    )


@query(
    "charge_recompute",
    """
    WITH t AS (
        SELECT l_linestatus, l_linestatus = 'O' AS buy, l_extendedprice::DECIMAL(18,2) AS g, round_even(l_extendedprice::DECIMAL(18,2) * 0.0005, 2)::DECIMAL(18,2) AS b FROM lineitem),
    c AS (
        SELECT *, round_even(g * 0.001000, 2) AS stt, round_even(b * 0.180000, 2) AS gst, CASE WHEN buy THEN round_even(g * 0.000150, 2) ELSE 0 END AS stamp FROM t)
    SELECT l_linestatus, count(*)::BIGINT AS trades, sum(stt)::DOUBLE AS stt, sum(gst)::DOUBLE AS gst, sum(stamp)::DOUBLE AS stamp_duty,
           sum(CASE WHEN buy THEN g + b + stt + gst ELSE g - b - stt - gst END)::DOUBLE AS net,
           count(*) FILTER (WHERE NOT buy)::BIGINT AS old_rule_differs
    FROM c GROUP BY l_linestatus
    """,
)
def charge_recompute(spark, sf):
    """Charges of every trade, and how many an older rule (tax on buys only) would change."""
    gross = fin.money(F.col("l_extendedprice"))
    brokerage = F.bround(gross * F.lit("0.0005").cast("decimal(8,4)"), 2).cast("decimal(18,2)")
    t = table(spark, sf, "lineitem").select(
        "l_linestatus",
        (F.col("l_linestatus") == "O").alias("buy"),
        gross.alias("gross"),
        brokerage.alias("brokerage"),
    )
    c = fin.charges(
        F.col("buy"), F.col("gross"), F.col("brokerage"), "0.001", "0.00015", "0.18"
    )
    t = t.select("l_linestatus", "buy", *[v.alias(k) for k, v in c.items()])
    old = F.when(F.col("buy"), F.col("stt")).otherwise(0)
    return t.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("trades"),
        *[F.sum(k).cast("double").alias(k) for k in ("stt", "gst", "stamp_duty", "net")],
        F.count_if(~F.col("buy") & (old != F.col("stt")) | (F.col("buy") & (old != F.col("stt")))).alias(
            "old_rule_differs"
        ),
    )


@query(
    "accrual_30_360",
    """
    WITH d AS (
        SELECT l_linenumber, o_orderdate::DATE AS issue, l_shipdate::DATE AS day, l_quantity::DECIMAL(12,2) AS units
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate),
    m AS (
        SELECT *, (year(day) - year(issue)) * 12 + month(day) - month(issue)
                  - CASE WHEN day(day) < day(issue) AND day <> last_day(day) THEN 1
                         WHEN day(day) < day(issue) AND day = last_day(day) AND issue <> last_day(issue) THEN 1 ELSE 0 END AS months FROM d),
    c AS (SELECT *, (issue + to_months(((months // 6) * 6)::INT))::DATE AS last_coupon FROM m),
    a AS (
        SELECT *, 360 * (year(day) - year(last_coupon)) + 30 * (month(day) - month(last_coupon))
                  + CASE WHEN day(day) = 31 AND least(day(last_coupon), 30) = 30 THEN 30 ELSE day(day) END - least(day(last_coupon), 30) AS days FROM c)
    SELECT l_linenumber, count(*)::BIGINT AS lots, sum(days)::BIGINT AS days, sum(units * days)::DOUBLE AS unit_days FROM a GROUP BY 1
    """,
)
def accrual_30_360(spark, sf):
    """Every lot is a bond issued on the order day and valued on the ship day, coupons half-yearly."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lots = (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .where("l_shipdate >= o_orderdate")
    )
    issue, day = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    days = fin.days_30_360(fin.last_semiannual(issue, day), day)
    return (
        lots.select("l_linenumber", days.alias("days"), F.col("l_quantity").cast("decimal(12,2)").alias("u"))
        .groupBy("l_linenumber")
        .agg(
            F.count(F.lit(1)).alias("lots"),
            F.sum("days").alias("days"),
            F.sum(F.col("u") * F.col("days")).cast("double").alias("unit_days"),
        )
    )


@query(
    "corporate_action_factor",
    """
    WITH a AS (
        SELECT user_id, CASE event_type WHEN 'click' THEN 1.01 WHEN 'view' THEN 1.02 ELSE 1.0 END AS f FROM events)
    SELECT user_id, round(exp(sum(ln(f))), 6) AS factor, count(*)::BIGINT AS actions FROM a GROUP BY user_id
    """,
)
def corporate_action_factor(spark, sf):
    """Clicks are 1-for-100 bonuses, views 51-for-50 splits; other events leave the factor alone."""
    kind = F.when(F.col("event_type") == "click", "BONUS").when(
        F.col("event_type") == "view", "SPLIT"
    ).otherwise("DIVIDEND")
    e = table(spark, sf, "events").select("user_id", kind.alias("action"))
    numerator = F.when(F.col("action") == "BONUS", 1).otherwise(51)
    denominator = F.when(F.col("action") == "BONUS", 100).otherwise(50)
    out = W.factor_product(e, ["user_id"], fin.action_factor(F.col("action"), numerator, denominator))
    return out.withColumn("factor", F.round("factor", 6))


@query(
    "null_result",
    """
    SELECT c_name, c_mktsegment, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE c_acctbal < -99999 AND o_orderstatus = 'P'
    """,
)
def null_result(spark, sf):
    """A well-formed question whose answer is the empty set; the schema still comes back."""
    c = table(spark, sf, "customer").where("c_acctbal < -99999")
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_name", "c_mktsegment", "o_orderpriority"
    )


@query(
    "fiscal_quarter_counts",
    """
    SELECT CASE WHEN month(o_orderdate) BETWEEN 4 AND 6 THEN 1 WHEN month(o_orderdate) BETWEEN 7 AND 9 THEN 2
                WHEN month(o_orderdate) >= 10 THEN 3 ELSE 4 END::BIGINT AS quarter, count(*)::BIGINT AS n
    FROM orders WHERE o_orderdate >= DATE '1997-04-01' AND o_orderdate < DATE '1998-04-01' GROUP BY 1
    """,
)
def fiscal_quarter_counts(spark, sf):
    o = table(spark, sf, "orders").where(cal.in_fiscal_year(F.col("o_orderdate"), 1997))
    q = cal.fiscal_quarter(F.col("o_orderdate")).cast("long").alias("quarter")
    return o.groupBy(q).agg(F.count(F.lit(1)).alias("n"))


@query(
    "chained_refinement",
    """
    WITH t1 AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1997-04-01' AND o_orderdate < DATE '1998-04-01'),
    t2 AS (SELECT t1.*, c_mktsegment, c_nationkey FROM t1 JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0),
    t3 AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS v FROM t2 GROUP BY ALL)
    SELECT c_mktsegment, c_nationkey, n::BIGINT AS n, v::DOUBLE AS value FROM t3 WHERE n >= 2
    """,
)
def chained_refinement(spark, sf):
    """Three turns, each over the result of the turn before."""
    first = table(spark, sf, "orders").where(cal.in_fiscal_year(F.col("o_orderdate"), 1997))
    c = table(spark, sf, "customer").where("c_acctbal > 0")
    second = first.join(c, F.col("o_custkey") == F.col("c_custkey"))
    third = second.groupBy("c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"),
    )
    return third.where("n >= 2")


@query(
    "missed_target",
    f"""
    WITH r AS (
        SELECT s_suppkey, s_nationkey, coalesce(sum({NET}), 0)::DECIMAL(28,4) AS revenue
        FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_shipdate >= DATE '1998-04-01' AND l_shipdate < DATE '1999-04-01'
        GROUP BY ALL),
    t AS (SELECT s_nationkey, avg(revenue)::DOUBLE AS target FROM r GROUP BY 1)
    SELECT s_suppkey, revenue::DOUBLE AS revenue, round(target, 2) AS target FROM r JOIN t USING (s_nationkey) WHERE revenue::DOUBLE < target - 0.01
    """,
)
def missed_target(spark, sf):
    sold = (
        table(spark, sf, "lineitem")
        .where(cal.in_fiscal_year(F.col("l_shipdate"), 1998))
        .groupBy("l_suppkey")
        .agg(F.sum(_net()).alias("net"))
    )
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    revenue = s.join(sold, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        "s_suppkey", "s_nationkey", F.coalesce("net", F.lit(0)).cast("decimal(28,4)").alias("revenue")
    )
    # targets per nation are one small row each and come back by an ordinary join
    target = revenue.groupBy("s_nationkey").agg(
        (F.sum("revenue").cast("double") / F.count(F.lit(1))).alias("target")
    )
    r = F.col("revenue").cast("double")
    return (
        revenue.join(target, "s_nationkey")
        .where(r < F.col("target") - 0.01)
        .select("s_suppkey", r.alias("revenue"), F.round("target", 2).alias("target"))
    )


@query(
    "near_threshold",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 5000 AND c_acctbal >= 4500",
)
def near_threshold(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return W.near_threshold(c, "c_acctbal", F.lit(5000.0), 0.1)


@query(
    "attribution_variant",
    f"""
    WITH a AS (SELECT l_suppkey AS owner, sum({NET}) AS x FROM lineitem GROUP BY 1),
    b AS (SELECT CASE WHEN l_linenumber = 1 THEN l_suppkey // 2 ELSE l_suppkey END AS owner, sum({NET}) AS y FROM lineitem GROUP BY 1)
    SELECT owner, coalesce(x, 0)::DOUBLE AS by_first, coalesce(y, 0)::DOUBLE AS by_second
    FROM a FULL JOIN b USING (owner) WHERE coalesce(x, 0) <> coalesce(y, 0)
    """,
)
def attribution_variant(spark, sf):
    second = F.expr("if(l_linenumber = 1, l_suppkey div 2, l_suppkey)")
    out = W.attribution_difference(
        table(spark, sf, "lineitem"), F.col("l_suppkey"), second, _net()
    )
    return out.select(
        "owner", F.col("by_first").cast("double"), F.col("by_second").cast("double")
    )


@query(
    "allocation_drift",
    f"""
    WITH a AS (SELECT l_suppkey, l_returnflag, sum({NET}) AS amount FROM lineitem GROUP BY ALL),
    w AS (SELECT *, (100 * amount / sum(amount) OVER (PARTITION BY l_suppkey))::DOUBLE AS weight FROM a),
    t(flag, target, low, high) AS (VALUES ('A', 35.0, 32.0, 36.0), ('N', 35.0, 30.0, 34.0), ('R', 30.0, 25.0, 35.0))
    SELECT l_suppkey, l_returnflag, round(weight, 6) AS weight, round(weight - target, 6) AS drift,
           CASE WHEN weight < low THEN 'under' WHEN weight > high THEN 'over' ELSE 'inside' END AS state
    FROM w JOIN t ON flag = l_returnflag
    """,
)
def allocation_drift(spark, sf):
    target = spark.sql(
        "SELECT * FROM VALUES ('A', 35D, 32D, 36D), ('N', 35D, 30D, 34D), ('R', 30D, 25D, 35D) "
        "AS t(l_returnflag, target_weight, min_weight, max_weight)"
    )
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", _net().alias("net"))
    out = W.allocation_drift(li, target, "l_suppkey", "l_returnflag", "net")
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "drift")})


@query(
    "recurring_progress",
    """
    WITH m AS (
        SELECT c_mktsegment, o_custkey, count(*) AS planned, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
               min(o_orderdate::DATE) FILTER (WHERE o_orderstatus <> 'F') AS next_run
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_mktsegment, count(*)::BIGINT AS mandates, sum(planned)::BIGINT AS planned, sum(done)::BIGINT AS completed,
           count(*) FILTER (WHERE done = planned)::BIGINT AS finished, min(next_run) AS next_run FROM m GROUP BY 1
    """,
)
def recurring_progress(spark, sf):
    done = F.col("o_orderstatus") == "F"
    m = (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("planned"),
            F.count_if(done).alias("done"),
            F.min(F.when(~done, F.col("o_orderdate"))).alias("next_run"),
        )
    )
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (
        m.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(
            F.count(F.lit(1)).alias("mandates"),
            F.sum("planned").alias("planned"),
            F.sum("done").alias("completed"),
            F.count_if(F.col("done") == F.col("planned")).alias("finished"),
            F.min("next_run").cast("date").alias("next_run"),
        )
    )


@query(
    "rank_within_group",
    """
    SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS rank,
           dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS dense_rank FROM orders
    """,
)
def rank_within_group(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return W.rank_within(o, "o_orderpriority", "o_totalprice").select(
        "o_orderkey", "rank", "dense_rank"
    )


@query(
    "running_total",
    """
    WITH d AS (SELECT o_orderstatus, o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2)) AS amount FROM orders GROUP BY ALL)
    SELECT o_orderstatus, day, amount::DOUBLE AS amount, (sum(amount) OVER (PARTITION BY o_orderstatus ORDER BY day))::DOUBLE AS running FROM d
    """,
)
def running_total(spark, sf):
    out = W.running_by_day(
        table(spark, sf, "orders"),
        ["o_orderstatus"],
        F.col("o_orderdate").cast("date"),
        F.col("o_totalprice").cast("decimal(18,2)"),
    )
    return out.select(
        "o_orderstatus", "day", F.col("amount").cast("double"), F.col("running").cast("double")
    )


@query(
    "running_total_rows",
    """
    SELECT o_orderkey, (sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::DOUBLE AS running
    FROM orders
    """,
)
def running_total_rows(spark, sf):
    """Row by row running total whose groups are a third of the table each."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    out = running_sum(
        o,
        ["o_orderstatus"],
        ["o_orderdate", "o_orderkey"],
        {"running": F.col("o_totalprice").cast("decimal(18,2)")},
    )
    return out.select("o_orderkey", F.col("running").cast("double").alias("running"))


@query(
    "percentiles",
    """
    SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS band,
           round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 8) AS percent_rank FROM customer
    """,
)
def percentiles(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = W.percentile_bands(c, "c_mktsegment", "c_acctbal", "c_custkey", 4)
    return out.select("c_custkey", "band", F.round("percent_rank", 8).alias("percent_rank"))


@query(
    "percentile_values",
    """
    SELECT p_brand, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(quantile_cont(p_retailprice, 0.5), 6) AS q2,
           round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part GROUP BY p_brand
    """,
)
def percentile_values(spark, sf):
    prices = table(spark, sf, "part").select("p_brand", "p_retailprice")
    out = quantiles(prices, ["p_brand"], "p_retailprice", {"q1": 0.25, "q2": 0.5, "p90": 0.9})
    return out.select("p_brand", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "p90")])


@query(
    "period_change",
    """
    WITH d AS (SELECT event_type, ts::DATE AS day, sum(value::DECIMAL(18,4)) AS close FROM events GROUP BY ALL)
    SELECT event_type, day, close::DOUBLE AS close, (lag(close) OVER w)::DOUBLE AS previous, (close - lag(close) OVER w)::DOUBLE AS change,
           round(avg(close::DOUBLE) OVER (PARTITION BY event_type ORDER BY day ROWS 2 PRECEDING), 6) AS moving_mean
    FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)
    """,
)
def period_change(spark, sf):
    daily = (
        table(spark, sf, "events")
        .groupBy("event_type", F.col("ts").cast("date").alias("day"))
        .agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("close"))
    )
    out = W.period_change(daily, ["event_type"], "day", "close")
    return out.select(
        "event_type",
        "day",
        *[F.col(c).cast("double").alias(c) for c in ("close", "previous", "change")],
        F.round(F.col("moving_mean").cast("double"), 6).alias("moving_mean"),
    )


@query(
    "latest_snapshot",
    """
    SELECT user_id, event_type, first(ts ORDER BY ts DESC, event_id DESC) AS ts, first(value ORDER BY ts DESC, event_id DESC) AS value
    FROM events GROUP BY ALL
    """,
)
def latest_snapshot(spark, sf):
    return W.latest(
        table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["ts", "value"]
    )


@query(
    "as_of_join",
    """
    WITH p AS (SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = 'click' GROUP BY ALL),
    q AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click')
    SELECT event_id, price FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.ts >= p.ts
    """,
)
def as_of_join(spark, sf):
    """Every other event takes the latest click value of its user."""
    e = table(spark, sf, "events")
    left = e.where("event_type <> 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", "value")
    out = T.as_of(left, right, ["user_id"], "ts", "value", F.col("ts").cast("date"), "price")
    return out.select("event_id", "price")


def _dimension(spark, sf):
    """Versions of a customer: one per order, valid until the day before the next order day."""
    from pyspark.sql import Window

    days = table(spark, sf, "orders").groupBy(
        "o_custkey", F.col("o_orderdate").cast("date").alias("effective_from")
    ).agg(F.max("o_totalprice").alias("limit_value"))
    # one row per (customer, day): bounded by the calendar
    w = Window.partitionBy("o_custkey").orderBy("effective_from")
    nxt = F.lead("effective_from").over(w)
    return days.select(
        "o_custkey",
        "effective_from",
        F.date_sub(nxt, 1).cast("string").alias("effective_to"),
        nxt.isNull().alias("is_current"),
        "limit_value",
    )


DIMENSION = """
WITH d AS (SELECT o_custkey, o_orderdate::DATE AS f, max(o_totalprice) AS v FROM orders GROUP BY ALL),
s AS (SELECT *, lead(f) OVER (PARTITION BY o_custkey ORDER BY f) AS nxt FROM d)
"""


@query("scd_current", DIMENSION + "SELECT o_custkey, f AS effective_from, v AS limit_value FROM s WHERE nxt IS NULL")
def scd_current(spark, sf):
    return T.current_rows(_dimension(spark, sf)).select("o_custkey", "effective_from", "limit_value")


@query(
    "scd_point_in_time",
    DIMENSION
    + "SELECT o_custkey, f AS effective_from, v AS limit_value FROM s WHERE f <= DATE '1998-06-30' AND (nxt IS NULL OR nxt > DATE '1998-06-30')",
)
def scd_point_in_time(spark, sf):
    return T.rows_at(_dimension(spark, sf), F.lit("1998-06-30").cast("date")).select(
        "o_custkey", "effective_from", "limit_value"
    )
