"""Grading queries: one task per supplier, answers derived from its order lines.

The gold answer of a task is its revenue per (return flag, line status), rounded to two places.
Three runs predict it; the way a run answers follows from (supplier + run) mod 10:
0 as gold, 1 other names and unrounded, 2 wrong amounts on R rows, 3 A rows twice, 4 N rows left
out, 5 one more column, 6 no rows, 7 null, 8 not sent, 9 other case and blanks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import cells as C
from assayer.operators import compare as K
from assayer.operators import grade as G
from assayer.operators import relax as R
from assayer.plans.registry import query
from assayer.sources import answers as A
from assayer.session import cut_lineage, table

RUNS = ("0", "1", "2")
KEY = ["run_id", "task_id"]


def _lines(spark, sf):
    """Exact revenue and count per supplier, flag and status."""
    net = F.col("l_extendedprice").cast("decimal(14,2)") * (
        F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    )
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", "l_returnflag", "l_linestatus")
        .agg(F.sum(net).alias("exact"), F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("S"), "l_suppkey").alias("task_id"),
            "l_suppkey",
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            "exact",
            F.bround("exact", 2).alias("amount"),
            "n",
            # position inside the answer: flags A N R by statuses F O
            (
                F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4)
                + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
            ).alias("slot"),
        )
    )


def _tasks(spark, sf):
    key = F.col("s_suppkey")
    method = (
        F.when(key % 3 == 0, "Set-Match").when(key % 3 == 1, "Ordered-List-Match").otherwise("Exact")
    )
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("task_id"),
        key.alias("s_suppkey"),
        method.alias("scoring_method"),
        F.lit("Rows").alias("answer_type"),
        F.lit(None).cast("string").alias("value_tolerance"),
        (key % 8 + 1).cast("int").alias("tier"),
    )


def _gold(lines):
    typed = lines.select(
        "task_id",
        F.col("slot").alias("row_pos"),
        F.col("flag").alias("returnflag"),
        F.col("status").alias("linestatus"),
        F.col("amount").cast("double").alias("revenue"),
        F.col("n").alias("lines"),
    )
    return _positions(K.answer_rows(typed, ["task_id"], order="row_pos"), ["task_id"])


def _positions(rows, keys):
    """Dense positions: an answer here has at most twelve rows, so its window is tiny."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("row_pos")
    return rows.withColumn("row_pos", (F.row_number().over(w) - 1).cast("long"))


def _variant(run, key):
    return (key + run) % 10


def _pred(lines):
    runs = F.explode(F.array(*[F.lit(int(r)) for r in RUNS])).alias("run")
    df = lines.select("*", runs).withColumn("v", _variant(F.col("run"), F.col("l_suppkey")))
    df = df.where(F.col("v").isin(0, 1, 2, 3, 4, 5, 9) & ~((F.col("v") == 4) & (F.col("flag") == "N")))
    twice = F.when(
        (F.col("v") == 3) & (F.col("flag") == "A"), F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    df = df.withColumn("copy", F.explode(twice))
    odd = F.col("v") == 9
    flag = F.when(odd, F.concat(F.lit(" "), F.lower("flag"), F.lit(" "))).otherwise(F.col("flag"))
    revenue = (
        F.when(F.col("v") == 1, F.col("exact").cast("double"))
        .when(
            (F.col("v") == 2) & (F.col("flag") == "R"),
            (F.col("amount") + F.lit("0.07").cast("decimal(4,2)")).cast("double"),
        )
        .otherwise(F.col("amount").cast("double"))
    )
    base = df.select(
        F.col("run").cast("string").alias("run_id"),
        "task_id",
        "v",
        (F.col("slot") * 2 + F.col("copy")).alias("row_pos"),
        flag.alias("returnflag"),
        F.col("status").alias("linestatus"),
        revenue.alias("revenue"),
        F.col("n").alias("lines"),
    )
    keys = [*KEY, "v"]
    plain = K.answer_rows(base.where("v not in (1, 5)"), keys, order="row_pos")
    renamed = K.answer_rows(
        base.where("v = 1").select(
            *keys, "row_pos", F.col("lines").alias("cnt"), F.col("returnflag").alias("f"),
            F.col("revenue").alias("rev"), F.col("linestatus").alias("st"),
        ),
        keys,
        order="row_pos",
    )
    wider = K.answer_rows(
        base.where("v = 5").select(*keys, "row_pos", F.lit("x").alias("source"), "returnflag",
                                   "linestatus", "revenue", "lines"),
        keys,
        order="row_pos",
    )
    return _positions(plain.unionByName(renamed).unionByName(wider).drop("v"), KEY)


def _answered(tasks):
    """(run, task, raw) of every prediction that was sent."""
    runs = F.explode(F.array(*[F.lit(int(r)) for r in RUNS])).alias("run")
    df = tasks.select("task_id", "s_suppkey", runs)
    v = _variant(F.col("run"), F.col("s_suppkey"))
    return (
        df.select(
            F.col("run").cast("string").alias("run_id"),
            "task_id",
            v.alias("v"),
            F.when(v == 7, "null").otherwise("list").alias("raw"),
        )
        .where("v <> 8")
        .drop("v")
    )


def _frames(spark, sf):
    # both sides and every way of answering read the same sums: the lines are scanned once
    lines, tasks = cut_lineage(_lines(spark, sf)), _tasks(spark, sf)
    return lines, tasks, _gold(lines), _pred(lines)


def _row_pairs(tasks):
    return _answered(tasks).where("raw = 'list'").select(*KEY)


BASE = """
WITH f AS (
    SELECT l_suppkey, l_returnflag AS flag, l_linestatus AS status, count(*) AS n,
           sum(l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2))) AS exact
    FROM lineitem GROUP BY ALL),
g AS (
    SELECT s_suppkey AS k, 'S' || s_suppkey AS task_id, count(f.n) AS n,
           count(*) FILTER (WHERE flag = 'R') AS nr, count(*) FILTER (WHERE flag = 'N') AS nn,
           count(*) FILTER (WHERE flag = 'A') AS na,
           count(*) FILTER (WHERE exact = round_even(exact, 2)) AS ne
    FROM supplier LEFT JOIN f ON l_suppkey = s_suppkey GROUP BY ALL),
p AS (SELECT *, r::VARCHAR AS run_id, (k + r) % 10 AS v FROM g, (VALUES (0), (1), (2)) runs(r)),
c AS (
    SELECT *, CASE v WHEN 1 THEN ne WHEN 2 THEN n - nr WHEN 4 THEN n - nn WHEN 5 THEN 0 WHEN 6 THEN 0
                     ELSE n END AS tp,
           CASE v WHEN 4 THEN n - nn WHEN 6 THEN 0 ELSE n END AS np
    FROM p WHERE v NOT IN (7, 8))
"""


def _rates_sql(tp: str, np: str, n: str) -> str:
    p = f"(CASE WHEN {np} > 0 THEN {tp} / {np} WHEN {n} = 0 THEN 1 ELSE 0 END)::DOUBLE"
    r = f"(CASE WHEN {n} > 0 THEN {tp} / {n} WHEN {np} = 0 THEN 1 ELSE 0 END)::DOUBLE"
    return (
        f"{p} AS precision, {r} AS recall, "
        f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END)::DOUBLE AS row_f1"
    )


@query(
    "score_join",
    BASE
    + """
    SELECT run_id, count(*)::BIGINT AS pairs, count(*) FILTER (WHERE v = 8)::BIGINT AS missing,
           count(*) FILTER (WHERE v = 7)::BIGINT AS no_answer,
           sum(CASE WHEN v IN (7, 8) THEN 0 WHEN v = 4 THEN n - nn WHEN v = 6 THEN 0
                    WHEN v = 3 THEN n + na ELSE n END)::BIGINT AS predicted_rows
    FROM p GROUP BY run_id
    """,
)
def score_join(spark, sf):
    lines, tasks, gold, pred = _frames(spark, sf)
    gold_head = K.answer_heads(gold, tasks.select("task_id"), ["task_id"])
    pred_head = K.answer_heads(pred, _answered(tasks), KEY)
    return (
        G.joined(tasks, gold_head, pred_head, RUNS)
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.count_if(F.col("raw").isNull()).alias("missing"),
            F.count_if(F.col("raw") == "null").alias("no_answer"),
            F.sum("pred_rows").alias("predicted_rows"),
        )
    )


@query(
    "set_match",
    BASE
    + f"""
    SELECT run_id, task_id, n AS gold_distinct, np AS pred_distinct, tp,
           {_rates_sql('tp', 'np', 'n')}, (tp = n AND tp = np) AS exact
    FROM c
    """,
)
def set_match(spark, sf):
    _, tasks, gold, pred = _frames(spark, sf)
    return K.set_match(K.signed(gold), K.signed(pred), _row_pairs(tasks))


@query(
    "multiset_match",
    BASE
    + f"""
    SELECT run_id, task_id, n AS gold_rows, np + CASE WHEN v = 3 THEN na ELSE 0 END AS pred_rows, tp,
           {_rates_sql('tp', '(np + CASE WHEN v = 3 THEN na ELSE 0 END)', 'n')},
           (tp = n AND tp = np + CASE WHEN v = 3 THEN na ELSE 0 END) AS exact
    FROM c
    """,
)
def multiset_match(spark, sf):
    _, tasks, gold, pred = _frames(spark, sf)
    return K.multiset_match(K.signed(gold), K.signed(pred), _row_pairs(tasks))


@query(
    "tolerant_row_match",
    """
    WITH f AS (
        SELECT l_linenumber, l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2)) AS x FROM lineitem)
    SELECT l_linenumber, count(*)::BIGINT AS n,
           count(*) FILTER (WHERE l_linenumber NOT IN (2, 5))::BIGINT AS equal
    FROM f GROUP BY l_linenumber
    """,
)
def tolerant_row_match(spark, sf):
    """Each line against a reordered, renamed, unrounded copy; lines 2 and 5 are spoilt."""
    net = F.col("l_extendedprice").cast("decimal(14,2)") * (
        F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    )
    line = F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select(
        "l_linenumber",
        F.bround(net, 2).cast("double").alias("net"),
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"),
        F.when(line == 2, F.lit("none"))
        .otherwise(F.concat(F.lower("l_returnflag"), F.lit(" ")))
        .alias("a"),
        F.when(line == 5, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).cast("double").alias("b"),
        net.cast("double").alias("c"),
    )
    df, _, prepared = C.prepared_columns(df, ["net", "part", "flag", "a", "b", "c"])
    pairs = df.select("l_linenumber", prepared.alias("v")).select(
        "l_linenumber", F.slice("v", 1, 3).alias("g"), F.slice("v", 4, 3).alias("p")
    )
    same = C.rows_equal(F.col("g"), F.col("p"), F.lit(C.ABS_TOL), F.lit(C.REL_TOL))
    return (
        pairs.select("l_linenumber", same.alias("same"))
        .groupBy("l_linenumber")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("equal"))
    )


@query(
    "greedy_assignment",
    BASE
    + """
    SELECT run_id, task_id, (CASE v WHEN 1 THEN n ELSE tp END)::BIGINT AS matched FROM c
    """,
)
def greedy_assignment(spark, sf):
    _, tasks, gold, pred = _frames(spark, sf)
    sizes = K.answer_heads(gold, tasks.select("task_id"), ["task_id"]).select(
        "task_id", F.col("n_rows").alias("gold_rows")
    )
    heads = K.answer_heads(pred, _answered(tasks).where("raw = 'list'"), KEY)
    pairs = heads.select(*KEY, F.col("n_rows").alias("pred_rows")).join(sizes, "task_id")
    pairs = pairs.select(
        *KEY,
        "gold_rows",
        "pred_rows",
        F.lit(C.ABS_TOL).alias("abs_tol"),
        F.lit(C.REL_TOL).alias("rel_tol"),
        F.lit(False).alias("in_order"),
    )
    return K.greedy_assignment(gold, pred, pairs)


@query(
    "greedy_large",
    """
    WITH l AS (
        SELECT l_returnflag, l_orderkey % 10 AS d,
               l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2)) * 0.0001::DECIMAL(5,4) AS x FROM lineitem),
    f AS (SELECT l_returnflag, d, round_even(x, 0) AS v, x FROM l),
    g AS (SELECT l_returnflag, v, count(*) AS g, count(*) FILTER (WHERE d <> 0) AS p0,
                 count(*) FILTER (WHERE d = 0) AS p1 FROM f GROUP BY ALL)
    SELECT run_id, l_returnflag AS task_id, sum(CASE run_id WHEN '0' THEN g WHEN '1' THEN p0 ELSE least(g, 2 * p1) END)::BIGINT AS matched
    FROM g, (VALUES ('0'), ('1'), ('2')) r(run_id) GROUP BY ALL
    """,
)
def greedy_large(spark, sf):
    """Answers of thousands of rows: whole amounts against unrounded ones, so few gold rows have many copies and partners.

    Run 0 sends every amount; in run 1 a tenth is spoilt; run 2 sends that tenth only, twice.
    """
    net = F.col("l_extendedprice").cast("decimal(14,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("task_id"),
        (F.col("l_orderkey") % 10 == 0).alias("tenth"),
        (net * F.lit("0.0001").cast("decimal(5,4)")).alias("amount"),
    )
    gold = K.answer_rows(lines.select("task_id", F.bround("amount", 0).cast("long").alias("amount")), ["task_id"])
    runs = F.when(F.col("tenth"), F.array(*map(F.lit, "0122"))).otherwise(F.array(*map(F.lit, "01")))
    sent = lines.select("task_id", "tenth", "amount", F.explode(runs).alias("run_id"))
    amount = F.when(F.col("tenth") & (F.col("run_id") == "1"), F.col("amount") + 100_000).otherwise(F.col("amount"))
    pred = K.answer_rows(sent.select("run_id", "task_id", amount.cast("decimal(24,8)").alias("amount")), KEY)
    sizes = gold.groupBy("task_id").agg(F.count(F.lit(1)).alias("gold_rows"))
    pairs = pred.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pred_rows")).join(sizes, "task_id")
    limits = {"abs_tol": F.lit(C.ABS_TOL), "rel_tol": F.lit(C.REL_TOL), "in_order": F.lit(False)}
    return K.greedy_assignment(gold, pred, pairs.withColumns(limits))


@query(
    "ordered_match",
    BASE
    + """
    SELECT run_id, task_id,
           (CASE v WHEN 2 THEN nr = 0 WHEN 3 THEN na = 0 WHEN 4 THEN nn = 0 WHEN 5 THEN n = 0
                   WHEN 6 THEN n = 0 ELSE true END) AS in_order
    FROM c
    """,
)
def ordered_match(spark, sf):
    _, tasks, gold, pred = _frames(spark, sf)
    sizes = K.answer_heads(gold, tasks.select("task_id"), ["task_id"]).select(
        "task_id", F.col("n_rows").alias("gold_rows")
    )
    heads = K.answer_heads(pred, _answered(tasks).where("raw = 'list'"), KEY)
    tolerance = tasks.select(
        "task_id", F.lit(C.ABS_TOL).alias("abs_tol"), F.lit(C.REL_TOL).alias("rel_tol")
    )
    hits = K.ordered_hits(K.signed(gold), K.signed(pred), tolerance)
    in_order = (F.col("n_rows") == F.col("gold_rows")) & (
        F.coalesce("in_place", F.lit(0)) == F.col("gold_rows")
    )
    return (
        heads.join(sizes, "task_id").join(hits, KEY, "left").select(*KEY, in_order.alias("in_order"))
    )


@query(
    "column_jaccard",
    BASE
    + """
    SELECT run_id, task_id, (CASE v WHEN 1 THEN 0 WHEN 5 THEN 0.8 ELSE 1 END)::DOUBLE AS column_match
    FROM c WHERE np > 0
    """,
)
def column_jaccard(spark, sf):
    _, tasks, gold, pred = _frames(spark, sf)
    g = K.column_names(gold, ["task_id"]).withColumnRenamed("names", "g")
    p = K.column_names(pred, KEY).withColumnRenamed("names", "p")
    return p.join(g, "task_id").select(
        *KEY, K.jaccard(F.col("g"), F.col("p")).alias("column_match")
    )


def _scalar_frames(spark, sf):
    """Scalar tasks: number of customers and mean balance per nation against variants of both."""
    by = (
        table(spark, sf, "customer")
        .groupBy("c_nationkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bround(F.avg(F.col("c_acctbal").cast("decimal(14,2)")), 2).alias("mean"),
        )
    )
    return by


@query(
    "scalar_match",
    """
    WITH b AS (
        SELECT c_nationkey, count(*) AS n, c_nationkey % 4 AS v FROM customer GROUP BY c_nationkey)
    SELECT 'N' || c_nationkey AS task_id, (v <> 3) AS same, (v <> 3)::INT::DOUBLE AS row_f1 FROM b
    """,
)
def scalar_match(spark, sf):
    by = _scalar_frames(spark, sf)
    v = F.col("c_nationkey") % 4
    gold = F.when(v == 2, F.col("mean").cast("double")).otherwise(F.col("n").cast("double"))
    df = by.select(
        F.concat(F.lit("N"), "c_nationkey").alias("task_id"),
        gold.alias("g"),
        F.when(v == 0, F.col("n").cast("string"))
        .when(v == 1, F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(".0 ")))
        .when(v == 2, F.concat(F.col("mean").cast("string"), F.lit("0001")))
        .otherwise((F.col("n") + 1).cast("string"))
        .alias("p"),
    )
    df, _, prepared = C.prepared_columns(df, ["g", "p"])
    pair = df.select("task_id", prepared.alias("v"))
    same = C.cells_equal(F.col("v")[0], F.col("v")[1], F.lit(C.ABS_TOL), F.lit(C.REL_TOL))
    out = pair.select("task_id", same.alias("same"))
    return out.withColumn("row_f1", F.col("same").cast("double"))


def _mapping_pairs(tasks, gold, runs_frame):
    sizes = K.answer_heads(gold, tasks.select("task_id"), ["task_id"]).select(
        "task_id", F.col("n_rows").alias("gold_rows")
    )
    return runs_frame.join(sizes, "task_id").select(
        *KEY,
        F.lit("set").alias("method_class"),
        "gold_rows",
        F.lit(C.ABS_TOL).alias("abs_tol"),
        F.lit(C.REL_TOL).alias("rel_tol"),
    )


@query(
    "extra_column_relax",
    BASE + "SELECT run_id, task_id, 'pass' AS relaxed FROM c WHERE v = 5",
)
def extra_column_relax(spark, sf):
    _, tasks, gold, pred = _frames(spark, sf)
    wide = pred.where("size(cells) > 4")
    pairs = _mapping_pairs(tasks, gold, wide.select(*KEY).distinct())
    return R.try_mappings(K.signed(gold), wide, pairs)


@query(
    "requested_column_relax",
    BASE
    + """
    SELECT run_id, task_id, 'pass' AS relaxed FROM c
    WHERE v = 0 OR v = 5 OR v = 9 OR (v = 1 AND ne = n AND n > 0) OR (v = 2 AND nr = 0) OR (v = 4 AND nn = 0) OR (v = 3 AND na = 0)
    """,
)
def requested_column_relax(spark, sf):
    """Gold without the column nobody asked for, against answers that leave it out as well."""
    _, tasks, gold, pred = _frames(spark, sf)
    drop = "filter(cells, c -> c.name <> 'linestatus')"
    reduced = gold.drop("prep").withColumn("cells", F.expr(drop))
    narrow = pred.drop("prep").withColumn("cells", F.expr(drop))
    sizes = narrow.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pred_rows"))
    pairs = _mapping_pairs(tasks, gold, sizes).join(sizes, KEY).where("gold_rows = pred_rows")
    out = R.try_mappings(K.signed(reduced), narrow, pairs.drop("pred_rows"))
    return out.where(F.col("relaxed").isNotNull())


def _scored(spark, sf):
    lines, tasks, gold, pred = _frames(spark, sf)
    gold_head = K.answer_heads(gold, tasks.select("task_id"), ["task_id"])
    pred_head = K.answer_heads(pred, _answered(tasks), KEY)
    return G.score_tasks(tasks, gold_head, gold, pred_head, pred, RUNS)


VERDICT = (
    BASE
    + """,
s AS (
    SELECT *, CASE WHEN v IN (7, 8) THEN 0 WHEN v = 1 THEN n WHEN v = 2 THEN n - nr WHEN v = 4 THEN n - nn
                   WHEN v IN (5, 6) THEN 0 ELSE n END AS tp,
           CASE v WHEN 4 THEN n - nn WHEN 6 THEN 0 ELSE n END AS np,
           CASE WHEN v IN (7, 8) THEN false WHEN v = 2 THEN nr = 0 WHEN v = 4 THEN nn = 0 WHEN v = 6 THEN n = 0
                WHEN v = 3 THEN k % 3 <> 1 OR na = 0 ELSE true END AS passed
    FROM p)
"""
)


@query(
    "task_verdict",
    VERDICT
    + """
    SELECT run_id, task_id, passed, passed::INT::DOUBLE AS score,
           CASE WHEN v IN (7, 8) THEN 0 ELSE tp / nullif(np, 0) END::DOUBLE AS precision,
           CASE WHEN v IN (7, 8) THEN 0 ELSE tp / n END::DOUBLE AS recall,
           CASE v WHEN 1 THEN 0 WHEN 5 THEN 0.8 WHEN 6 THEN 0 WHEN 7 THEN 0 WHEN 8 THEN 0 ELSE 1 END::DOUBLE AS column_match,
           CASE v WHEN 7 THEN 'empty_prediction' WHEN 8 THEN 'missing_prediction' END AS error_type,
           CASE WHEN v IN (7, 8) THEN NULL WHEN v = 3 THEN n + na WHEN v = 4 THEN n - nn WHEN v = 6 THEN 0 ELSE n END::BIGINT AS predicted_row_count,
           (v = 5) AS extra_columns_relaxed
    FROM s
    """.replace("tp / nullif(np, 0)", "CASE WHEN np > 0 THEN tp / np ELSE 0 END"),
)
def task_verdict(spark, sf):
    return _scored(spark, sf).select(
        "run_id",
        "task_id",
        "passed",
        "score",
        "precision",
        "recall",
        "column_match",
        "error_type",
        "predicted_row_count",
        "extra_columns_relaxed",
    )


@query(
    "error_label",
    """
    WITH l AS (
        SELECT ['passed', 'rubric_pending', 'missing_prediction', 'missing_answer', 'empty_prediction', 'format_error',
                'scoring_exception', 'gold_sql_execution_error', 'ambiguous_column_mapping', 'failed'][s_suppkey % 10 + 1] AS label,
               ['None', 'empty string'][s_suppkey // 10 % 2 + 1] AS kind FROM supplier)
    SELECT label, CASE label
               WHEN 'rubric_pending' THEN 'Rubric scoring requires a judge evaluator (not yet implemented)'
               WHEN 'missing_prediction' THEN 'No prediction found for task'
               WHEN 'missing_answer' THEN 'Prediction row missing predicted_answer/answer'
               WHEN 'empty_prediction' THEN 'Agent produced no prediction (' || kind || ')'
               WHEN 'format_error' THEN 'Set answer must be a list'
               WHEN 'scoring_exception' THEN 'Answer is no readable JSON'
               WHEN 'gold_sql_execution_error' THEN 'statement of the task did not run'
               WHEN 'ambiguous_column_mapping' THEN 'Prediction has extra columns and more than one column mapping reproduces the gold values; gold column names do not resolve it'
           END AS message, count(*)::BIGINT AS n
    FROM l GROUP BY ALL
    """,
)
def error_label(spark, sf):
    """One task per supplier, answered in ten ways; eight of them end in a label.

    The gold answer has two rows of seven columns, each holding the balance and its negative. An ambiguous answer has eight columns with
    the same values, no seven of which make the gold rows.
    """
    s = table(spark, sf, "supplier")
    way = F.col("s_suppkey") % 10
    tasks = s.select(
        F.concat(F.lit("S"), "s_suppkey").alias("task_id"),
        F.when(way == 1, "Rubric").otherwise("Set-Match").alias("scoring_method"),
        F.lit("Rows").alias("answer_type"),
        F.lit(None).cast("string").alias("value_tolerance"),
    )
    one = F.abs("s_acctbal").cast("decimal(12,2)") + 1
    row = lambda firsts, width, x, y: F.concat_ws(",", *[F.concat(F.lit(f'"c{i}":'), x if i < firsts else y) for i in range(width)])
    rows = lambda firsts, width: F.concat(F.lit("[{"), row(firsts, width, one, -one), F.lit("},{"), row(firsts, width, -one, one), F.lit("}]"))
    answer = (
        F.when(way == 4, F.when((F.col("s_suppkey") / 10).cast("long") % 2 == 0, "null").otherwise('""'))
        .when(way == 5, F.concat(F.lit('"'), "s_name", F.lit('"')))
        .when(way == 6, F.lit('[{"c0": 1'))
        .when(way == 8, rows(2, 8))
        .when(way == 9, rows(3, 6))
        .otherwise(rows(4, 7))
    )
    key = F.concat(F.lit("S"), "s_suppkey").alias("task_id")
    gold = s.select(key, F.concat(F.lit('{"answer":'), rows(4, 7), F.lit("}")).alias("rec"))
    field = F.when(way == 3, "note").otherwise("answer")
    sent = s.where(way != 2).select(F.lit("0").alias("run_id"), key, F.concat(F.lit('{"'), field, F.lit('":'), answer, F.lit("}")).alias("rec"))
    failures = s.where(way == 7).select(
        F.lit(None).cast("string").alias("run_id"), key, F.lit("gold_sql_execution_error").alias("error_type"),
        F.lit("statement of the task did not run").alias("error_message"),
    )
    gold_head, gold_rows = A.parse_answers(gold, ["task_id"], ("answer",))
    pred_head, pred_rows = A.parse_answers(sent, KEY)
    scores = G.score_tasks(tasks, gold_head, gold_rows, pred_head, pred_rows, ["0"], failures=failures)
    label = F.coalesce("error_type", F.when(F.col("passed"), "passed").otherwise("failed"))
    return scores.groupBy(label.alias("label"), F.col("error_message").alias("message")).agg(F.count(F.lit(1)).alias("n"))


def _existence(spark, sf):
    """Existence checks per customer nation and order status: gold rows are the late big orders."""
    o = table(spark, sf, "orders").where("o_totalprice > 440000 and o_orderstatus = 'P'")
    c = table(spark, sf, "customer")
    found = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select("c_custkey", "o_orderkey")
        .withColumn("task_id", F.concat(F.lit("C"), "c_custkey"))
    )
    tasks = c.select(
        F.concat(F.lit("C"), "c_custkey").alias("task_id"),
        F.lit("Exact").alias("scoring_method"),
        F.lit("Rows").alias("answer_type"),
        F.lit(None).cast("string").alias("value_tolerance"),
        "c_custkey",
    )
    gold = K.answer_rows(found.select("task_id", "o_orderkey"), ["task_id"])
    return tasks, gold


EXISTENCE = """
WITH g AS (
    SELECT c_custkey, count(o_orderkey) AS n FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 440000 AND o_orderstatus = 'P'
    GROUP BY c_custkey)
"""


@query(
    "empty_set_relax",
    EXISTENCE
    + """
    SELECT (n = 0) AS gold_empty, c_custkey % 2 AS style, count(*)::BIGINT AS tasks,
           count(*) FILTER (WHERE n = 0 AND c_custkey % 2 = 0)::BIGINT AS passed,
           count(*) FILTER (WHERE n = 0 AND c_custkey % 2 = 0)::BIGINT AS relaxed
    FROM g GROUP BY ALL
    """,
)
def empty_set_relax(spark, sf):
    """Every check is answered by a count: 0 for even customers, 1 for odd ones."""
    tasks, gold = _existence(spark, sf)
    pred = K.answer_rows(
        tasks.select(
            F.lit("0").alias("run_id"), "task_id", (F.col("c_custkey") % 2).alias("n_found")
        ),
        KEY,
    )
    head = K.answer_heads(
        pred, tasks.select(F.lit("0").alias("run_id"), "task_id", F.lit("list").alias("raw")), KEY
    )
    gold_head = K.answer_heads(gold, tasks.select("task_id"), ["task_id"])
    scores = G.score_tasks(tasks, gold_head, gold, head, pred, ["0"])
    info = tasks.select("task_id", (F.col("c_custkey") % 2).alias("style")).join(
        gold_head.select("task_id", (F.col("n_rows") == 0).alias("gold_empty")), "task_id"
    )
    return (
        scores.join(info, "task_id")
        .groupBy("gold_empty", "style")
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            F.count_if("passed").alias("passed"),
            F.count_if("empty_set_relaxed").alias("relaxed"),
        )
    )


@query(
    "always_empty_floor",
    EXISTENCE
    + """
    SELECT count(*)::BIGINT AS tasks, count(*) FILTER (WHERE n = 0)::BIGINT AS passed,
           round(count(*) FILTER (WHERE n = 0) / count(*), 6) AS floor_rate
    FROM g
    """,
)
def always_empty_floor(spark, sf):
    """Score of a system that answers the empty set to every task."""
    tasks, gold = _existence(spark, sf)
    pairs = tasks.select(F.lit("0").alias("run_id"), "task_id")
    none = K.answer_rows(pairs.where("false").withColumn("x", F.lit(1)), KEY)
    head = K.answer_heads(none, pairs.withColumn("raw", F.lit("list")), KEY)
    gold_head = K.answer_heads(gold, tasks.select("task_id"), ["task_id"])
    return G.score_tasks(tasks, gold_head, gold, head, none, ["0"]).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if("passed").alias("passed"),
        F.round(F.count_if("passed") / F.count(F.lit(1)), 6).alias("floor_rate"),
    )
