"""Table audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import audit as Q
from assayer.plans.registry import query
from assayer.session import table

SMALL = ("region", "nation", "supplier", "part")


def _stat_sql(t: str, c: str, numeric: bool) -> str:
    rows = [("count", f"count({c})"), ("count_distinct", f"count(DISTINCT {c})")]
    if numeric:
        whole = c.endswith("key") or c.endswith("number")
        rows.append(("sum", f"sum({c})" if whole else f"sum({c}::VARCHAR::DECIMAL(38,12))"))
    zero = " + 0" if numeric else ""
    rows += [("min", f"min({c}{zero})"), ("max", f"max({c}{zero})")]
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{n}' AS stat, ({x})::VARCHAR AS value FROM {t}"
        for n, x in rows
    )


PROFILE_COLUMNS = {
    "lineitem": ["l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linenumber"],
    "orders": ["o_custkey", "o_totalprice", "o_orderpriority"],
    "customer": ["c_acctbal", "c_mktsegment"],
}
TEXT = {"l_returnflag", "o_orderpriority", "c_mktsegment"}


def _profiles(spark, sf, change=False):
    out = None
    for name, columns in PROFILE_COLUMNS.items():
        df = table(spark, sf, name).select(*columns)
        if change and name == "customer":
            moved = F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") * 2)
            df = df.withColumn("c_acctbal", moved.otherwise(F.col("c_acctbal")))
        part = Q.profile(df, name)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "table_profile",
    " UNION ALL ".join(
        _stat_sql(t, c, c not in TEXT) for t, cols in PROFILE_COLUMNS.items() for c in cols
    ),
)
def table_profile(spark, sf):
    return _profiles(spark, sf)


@query(
    "snapshot_equivalence",
    """
    WITH b AS (SELECT c_acctbal AS x, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal * 2 ELSE c_acctbal END AS y FROM customer),
    s AS (
        SELECT 'count_distinct' AS stat, count(DISTINCT x)::VARCHAR AS left_value, count(DISTINCT y)::VARCHAR AS right_value FROM b
        UNION ALL SELECT 'sum', sum(x::VARCHAR::DECIMAL(38,12))::VARCHAR, sum(y::VARCHAR::DECIMAL(38,12))::VARCHAR FROM b
        UNION ALL SELECT 'min', min(x)::VARCHAR, min(y)::VARCHAR FROM b
        UNION ALL SELECT 'max', max(x)::VARCHAR, max(y)::VARCHAR FROM b)
    SELECT 'customer' AS "table", 'c_acctbal' AS "column", stat, left_value, right_value FROM s WHERE left_value <> right_value
    """,
)
def snapshot_equivalence(spark, sf):
    return Q.snapshot_equivalence(_profiles(spark, sf), _profiles(spark, sf, True))


def _order_snapshots(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    later = o.where("o_orderkey % 50 <> 7").withColumn(
        "o_totalprice",
        F.when(F.col("o_orderkey") % 40 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    )
    later = later.withColumn(
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 30 == 4, F.lit("X")).otherwise(F.col("o_orderstatus")),
    )
    return o, later


SNAPSHOTS = """
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 30 = 4 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 40 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
      FROM orders WHERE o_orderkey % 50 <> 7)
"""


@query(
    "bidirectional_row_diff",
    SNAPSHOTS
    + """
    SELECT *, 'left' AS only_in, 1 AS copies FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT *, 'right', 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
    """,
)
def bidirectional_row_diff(spark, sf):
    return Q.row_diff(*_order_snapshots(spark, sf))


@query(
    "changed_columns",
    SNAPSHOTS
    + """
    SELECT 'o_orderstatus' AS "column", count(*)::BIGINT AS rows_changed FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus
    UNION ALL SELECT 'o_totalprice', count(*)::BIGINT FROM a JOIN b USING (o_orderkey) WHERE a.o_totalprice <> b.o_totalprice
    """,
)
def changed_columns(spark, sf):
    return Q.changed_columns(*_order_snapshots(spark, sf), ["o_orderkey"])


@query(
    "business_key_duplicates",
    """
    WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT sum(n)::BIGINT AS rows, count(*)::BIGINT AS distinct_keys, count(*) FILTER (WHERE n > 1)::BIGINT AS duplicated_groups,
           sum(n - 1)::BIGINT AS excess_rows FROM k
    """,
)
def business_key_duplicates(spark, sf):
    return Q.business_key_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "distinct_per_segment",
    """
    SELECT o_orderstatus, count(*)::BIGINT AS rows, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_totalprice END)::BIGINT AS n_distinct,
           o_orderstatus = 'P' AS degenerate FROM orders GROUP BY o_orderstatus
    """,
)
def distinct_per_segment(spark, sf):
    o = table(spark, sf, "orders")
    clipped = F.when(F.col("o_orderstatus") == "P", F.lit(1.0)).otherwise(F.col("o_totalprice"))
    return Q.distinct_per_segment(o.withColumn("price", clipped), "o_orderstatus", "price")


@query("constant_column", 'SELECT unnest([\'other_charges\', \'currency\']) AS "column" FROM (SELECT count(*) FROM lineitem)')
def constant_column(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", "l_returnflag", (F.col("l_tax") * 0).alias("other_charges"),
        F.when(F.col("l_tax") >= 0, "INR").alias("currency"),
    )
    return Q.constant_columns(li)


@query(
    "pair_correlation",
    """
    SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation, false AS degenerate, 'price' AS pair FROM lineitem
    UNION ALL SELECT round(corr(l_quantity, l_quantity * 3), 6), true, 'scaled' FROM lineitem
    """,
)
def pair_correlation(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_quantity") * 3).alias("x3"))
    rows = Q.pair_correlation(li, "l_quantity", "l_extendedprice").withColumn("pair", F.lit("price"))
    rows = rows.unionByName(
        Q.pair_correlation(li, "l_quantity", "x3").withColumn("pair", F.lit("scaled"))
    )
    return rows.withColumn("correlation", F.round("correlation", 6))


@query(
    "fk_integrity",
    """
    SELECT o_custkey AS key, count(*)::BIGINT AS n_rows FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) GROUP BY 1
    """,
)
def fk_integrity(spark, sf):
    parent = table(spark, sf, "customer").where("c_nationkey <> 3")
    return Q.fk_violations(table(spark, sf, "orders"), parent, "o_custkey", "c_custkey")


@query(
    "semi_anti",
    """
    SELECT 'with' AS side, count(*)::BIGINT AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'without', count(*)::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    """,
)
def semi_anti(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(c.join(o, "c_custkey", "left_semi"), "with").unionByName(
        count(c.join(o, "c_custkey", "left_anti"), "without")
    )


@query(
    "lifecycle_containment",
    """
    SELECT o_orderstatus, count(*)::BIGINT AS n_rows,
           count(*) FILTER (WHERE l_shipdate::DATE < o_orderdate::DATE)::BIGINT AS before_start,
           count(*) FILTER (WHERE l_shipdate::DATE > o_orderdate::DATE + 730)::BIGINT AS after_end
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus
    """,
)
def lifecycle_containment(spark, sf):
    """Every order is open for 730 days; lines ship inside, before or after that window."""
    joined = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(
        table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    start = F.col("o_orderdate").cast("date")
    return Q.lifecycle(
        joined, F.col("l_shipdate").cast("date"), start, F.date_add(start, 730), ["o_orderstatus"]
    )


@query(
    "rule_replay",
    """
    SELECT l_returnflag, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE l_discount < 0.05)::BIGINT AS disagree
    FROM lineitem GROUP BY l_returnflag
    """,
)
def rule_replay(spark, sf):
    """Replays the rule "discounts start at 5%" against the stored discounts."""
    rule = F.greatest(F.col("l_discount"), F.lit(0.05))
    return Q.replay(table(spark, sf, "lineitem"), F.col("l_discount"), rule, 1e-9, ["l_returnflag"])


@query(
    "before_after_rate",
    """
    SELECT 'before' AS snapshot, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE c_acctbal < 1000)::BIGINT AS met,
           count(*) FILTER (WHERE c_acctbal < 1000) / count(*) AS share FROM customer
    UNION ALL SELECT 'after', count(*)::BIGINT, count(*) FILTER (WHERE c_acctbal * 4 < 1000)::BIGINT,
           count(*) FILTER (WHERE c_acctbal * 4 < 1000) / count(*) FROM customer
    """,
)
def before_after_rate(spark, sf):
    c = table(spark, sf, "customer").select("c_acctbal")
    return Q.rate_by_snapshot(
        {"before": c, "after": c.select((F.col("c_acctbal") * 4).alias("c_acctbal"))},
        F.col("c_acctbal") < 1000,
    )


@query(
    "set_ops",
    """
    WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
    p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT k FROM f UNION SELECT k FROM p)
    UNION ALL SELECT 'intersect', count(*)::BIGINT FROM (SELECT k FROM f INTERSECT SELECT k FROM p)
    UNION ALL SELECT 'except', count(*)::BIGINT FROM (SELECT k FROM f EXCEPT SELECT k FROM p)
    """,
)
def set_ops(spark, sf):
    o = table(spark, sf, "orders")
    f = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    p = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct()
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return (
        count(f.union(p).distinct(), "union")
        .unionByName(count(f.intersect(p), "intersect"))
        .unionByName(count(f.subtract(p), "except"))
    )


@query(
    "gini",
    """
    WITH r AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) AS i FROM customer WHERE c_acctbal > 0)
    SELECT count(*)::BIGINT AS n, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM r
    """,
)
def gini(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select("c_acctbal")
    return Q.gini(c, "c_acctbal").withColumn("gini", F.round("gini", 6))
