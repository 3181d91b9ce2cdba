"""Verdict per (run, task): method, tolerance, labels and relaxations in one declarative plan.

Frames
------
``tasks``      task_id, scoring_method, answer_type, value_tolerance, any metadata
``gold_head``  task_id, shape, n_rows, columns, value
``pred_head``  run_id, task_id, raw, shape, n_rows, columns, value (+ latency, cost, ...)
``gold`` / ``pred``  answer rows (see ``compare``)

``shape`` is ``list`` or ``value``; ``raw`` is ``null``, ``empty_text``, ``missing_answer``, ``unreadable``,
``list``, ``dict`` or ``scalar``; ``value`` is the cell a scalar method compares.

What fails for one task is a row, not the end of the job: an answer that cannot be read, and the ``failures``
(run_id or null for every run, task_id, error_type, error_message) of whoever made the answers, such as a
statement that did not run. Such pairs are not compared and fail with their label and message.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import cells as C
from assayer.operators import compare as K
from assayer.operators import relax as R
from assayer.session import cut_lineage

# Method names of each class; a name in none of them is compared as a set.
SET_METHODS = ("Set-Match", "Set Match", "Exact-Set", "Unordered-Set", "Row-Set-Match", "Exact")
ORDERED_METHODS = ("Ordered-Match", "Ordered-List-Match", "List-Match")
SCALAR_METHODS = ("Scalar-Match", "Scalar Match", "Exact-Scalar")
RUBRIC_METHODS = ("Rubric",)


# Messages that go with the labels.
MESSAGES = {
    "rubric_pending": "Rubric scoring requires a judge evaluator (not yet implemented)",
    "missing_prediction": "No prediction found for task",
    "missing_answer": "Prediction row missing predicted_answer/answer",
    "ambiguous_column_mapping": "Prediction has extra columns and more than one column mapping reproduces the "
    "gold values; gold column names do not resolve it",
}


def method_class(method: Column, answer_type: Column) -> Column:
    return (
        F.when(method.isin(*RUBRIC_METHODS), "rubric")
        .when(F.coalesce(answer_type == "Scalar", F.lit(False)), "scalar")
        .when(method.isin(*SCALAR_METHODS), "scalar")
        .when(method.isin(*ORDERED_METHODS), "ordered")
        .otherwise("set")
    )


def tolerance(value: Column, default: float = C.ABS_TOL) -> Column:
    """The task's own absolute tolerance when it reads as a number."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(default))


def zero_count_row(n_rows: Column, prep: Column) -> Column:
    """One row with one cell that is numerically zero; booleans do not count."""
    first = prep[0]
    return F.coalesce(
        (n_rows == 1)
        & (F.size(prep) == 1)
        & first["kind"].isin("num", "str")
        & (first["dbl"] == 0.0),
        F.lit(False),
    )


def more_columns(pred: Column, gold: Column) -> Column:
    return F.size(pred) > F.size(gold)


def expected_pairs(tasks: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Every task once per run, predicted or not."""
    return tasks.withColumn("run_id", F.explode(F.array(*[F.lit(str(r)) for r in runs])))


def joined(tasks, gold_head, pred_head, runs) -> DataFrame:
    """One row per (run, task) with both heads; a missing prediction or gold answer stays as a row."""
    gold = gold_head.select(
        "task_id",
        F.col("shape").alias("gold_shape"),
        F.col("n_rows").alias("gold_rows"),
        F.col("columns").alias("gold_columns"),
        F.col("value").alias("gold_value"),
        (F.col("raw") if "raw" in gold_head.columns else F.lit(None).cast("string")).alias("gold_raw"),
    )
    pred = pred_head.select(
        F.col("run_id").cast("string").alias("run_id"),
        "task_id",
        "raw",
        F.col("shape").alias("pred_shape"),
        F.col("n_rows").alias("pred_rows"),
        F.col("columns").alias("pred_columns"),
        F.col("value").alias("pred_value"),
        *[c for c in pred_head.columns if c not in _HEAD],
    )
    return (
        expected_pairs(tasks, runs)
        .join(gold, "task_id", "left")
        .join(pred, ["run_id", "task_id"], "left")
    )


_HEAD = {"run_id", "task_id", "raw", "shape", "n_rows", "columns", "value"}


def error_before_compare(method: Column, raw: Column) -> Column:
    """Label of a pair that is never compared."""
    return (
        F.when(method == "rubric", "rubric_pending")
        .when(raw.isNull(), "missing_prediction")
        .when(raw == "missing_answer", "missing_answer")
        .when(raw.isin("null", "empty_text"), "empty_prediction")
        .when(raw == "unreadable", "scoring_exception")
    )


def message(label: Column, raw: Column, method: Column) -> Column:
    """What is said about a label that the verdict itself gives."""
    out = F.when(label == "empty_prediction", F.concat(
        F.lit("Agent produced no prediction ("), F.when(raw == "null", "None").otherwise("empty string"), F.lit(")")))
    out = out.when(label == "format_error", F.when(method == "ordered", "Ordered answer must be a list").otherwise("Set answer must be a list"))
    out = out.when(label == "missing_gold", "No gold answer found for task").when(label == "scoring_exception", "Answer is no readable JSON")
    for name, text in MESSAGES.items():
        out = out.when(label == name, text)
    return out


def with_failures(pairs: DataFrame, failures: DataFrame | None) -> DataFrame:
    """``pairs`` with ``failed`` and ``failed_message``: the first failure of its run, or of all runs, by name."""
    if failures is None:
        nothing = F.lit(None).cast("string")
        return pairs.withColumn("failed", nothing).withColumn("failed_message", nothing)
    runs = pairs.select("run_id").distinct()
    named = failures.where("run_id is not null").select(F.col("run_id").cast("string").alias("run_id"), "task_id", "error_type", "error_message")
    every = failures.where("run_id is null").select("task_id", "error_type", "error_message").join(F.broadcast(runs)).select(*named.columns)
    first = F.min(F.struct(F.col("error_type"), F.col("error_message")))
    each = named.unionByName(every).groupBy("run_id", "task_id").agg(first.alias("f"))
    each = each.select("run_id", "task_id", F.col("f.error_type").alias("failed"), F.col("f.error_message").alias("failed_message"))
    return pairs.join(each, ["run_id", "task_id"], "left")


def score_tasks(
    tasks: DataFrame,
    gold_head: DataFrame,
    gold: DataFrame,
    pred_head: DataFrame,
    pred: DataFrame,
    runs: Sequence[str],
    unrequested: DataFrame | None = None,
    failures: DataFrame | None = None,
    abs_tol: float = C.ABS_TOL,
    rel_tol: float = C.REL_TOL,
) -> DataFrame:
    """Score every task of every run; see the module text for the frames."""
    # parsed and signed rows are read by every later step, so they are written once
    pred = cut_lineage(K.signed(pred.withColumn("run_id", F.col("run_id").cast("string"))))
    gold = cut_lineage(K.signed(gold))
    pairs = joined(
        tasks.withColumn("method_class", method_class(F.col("scoring_method"), F.col("answer_type")))
        .withColumn("abs_tol", tolerance(F.col("value_tolerance"), abs_tol))
        .withColumn("rel_tol", F.lit(rel_tol)),
        gold_head,
        pred_head,
        runs,
    )
    pairs = with_failures(pairs, failures)
    rubric = F.col("method_class") == "rubric"
    label = error_before_compare(F.col("method_class"), F.col("raw"))
    no_gold = F.when(F.col("gold_shape").isNull(), "missing_gold").when(F.col("gold_raw") == "unreadable", "scoring_exception")
    label = F.coalesce(F.when(~rubric, F.col("failed")), label, no_gold)
    pairs = pairs.withColumn("label", label)
    by_rows = F.col("method_class").isin("set", "ordered")
    both_lists = (F.col("gold_shape") == "list") & (F.col("pred_shape") == "list")
    pairs = pairs.withColumn(
        "label",
        F.coalesce("label", F.when(by_rows & ~both_lists, F.lit("format_error"))),
    )
    pairs = cut_lineage(pairs)
    key = ["run_id", "task_id"]
    slim = pairs.where(F.col("label").isNull()).select(
        *key, "method_class", "gold_rows", "pred_rows", "abs_tol", "rel_tol"
    )
    row_pairs = slim.where(by_rows)
    is_ordered = F.col("method_class") == "ordered"

    sets = cut_lineage(K.set_match(gold, pred, row_pairs))
    open_pairs = sets.where(~F.col("exact")).withColumn("in_order", is_ordered)
    greedy = K.greedy_assignment(gold, pred, open_pairs)
    hits = K.ordered_hits(
        gold,
        pred.join(row_pairs.where(is_ordered).select(*key), key, "left_semi"),
        tasks.select(
            "task_id",
            tolerance(F.col("value_tolerance"), abs_tol).alias("abs_tol"),
            F.lit(rel_tol).alias("rel_tol"),
        ),
    )
    zeros = (
        pred.join(
            row_pairs.where("gold_rows = 0 and pred_rows = 1").select(*key, "pred_rows"), key
        )
        .select(*key, zero_count_row(F.col("pred_rows"), F.col("prep")).alias("zero_count"))
        .where("zero_count")
    )
    base = (
        sets.drop("abs_tol", "rel_tol")
        .join(greedy, key, "left")
        .join(hits, key, "left")
        .join(zeros, key, "left")
    )
    used = F.col("matched").isNotNull()
    base = K.rates(
        base,
        F.when(used, F.col("matched")).otherwise(F.col("tp")),
        F.when(used, F.col("pred_rows")).otherwise(F.col("pred_distinct")),
        F.when(used, F.col("gold_rows")).otherwise(F.col("gold_distinct")),
    )
    as_set = F.col("exact") | F.coalesce(
        (F.col("matched") == F.col("gold_rows")) & (F.col("matched") == F.col("pred_rows")),
        F.lit(False),
    )
    in_place = (F.col("gold_rows") == F.col("pred_rows")) & (
        F.coalesce("in_place", F.lit(0)) == F.col("gold_rows")
    )
    base = base.select(
        *key,
        F.when(is_ordered, in_place).otherwise(as_set).alias("same"),
        "precision",
        "recall",
        "row_f1",
        F.coalesce("zero_count", F.lit(False)).alias("zero_count"),
    )

    value_pairs = pairs.where(F.col("label").isNull() & (F.col("method_class") == "scalar")).select(
        *key,
        "abs_tol",
        "rel_tol",
        C.prepare(F.array("gold_value", "pred_value")).alias("v"),
    )
    same_value = value_pairs.select(
        *key,
        C.cells_equal(F.col("v")[0], F.col("v")[1], F.col("abs_tol"), F.col("rel_tol")).alias(
            "same"
        ),
    )
    full = F.col("same").cast("double")
    base = base.unionByName(
        same_value.select(
            *key,
            "same",
            full.alias("precision"),
            full.alias("recall"),
            full.alias("row_f1"),
            F.lit(False).alias("zero_count"),
        )
    )
    base = cut_lineage(base)

    open_cols = pairs.join(base.where("not same and not zero_count").select(*key), key, "left_semi")
    wide = open_cols.where(
        more_columns(F.col("pred_columns"), F.col("gold_columns"))
        & (F.col("gold_rows") > 0)
        & (F.col("gold_rows") == F.col("pred_rows"))
    )
    relaxed = _relax(gold, pred, wide)
    verdict = (
        pairs.join(base, key, "left")
        .join(relaxed, key, "left")
        .withColumn("wants", F.lit(None).cast("string"))
    )
    if unrequested is not None:
        drop = unrequested.groupBy("task_id").agg(F.collect_set("column").alias("dropped"))
        reduced_gold = gold.join(drop, "task_id").withColumn(
            "cells", F.expr("filter(cells, c -> not array_contains(dropped, c.name))")
        )
        asked = (
            open_cols.join(drop, "task_id")
            .withColumn("gold_columns", F.array_except("gold_columns", "dropped"))
            .where(
                (F.size("pred_columns") >= F.size("gold_columns"))
                & (F.col("gold_rows") > 0)
                & (F.col("gold_rows") == F.col("pred_rows"))
            )
        )
        wants = _relax(reduced_gold, pred, asked)
        verdict = verdict.drop("wants").join(
            wants.withColumnRenamed("relaxed", "wants"), key, "left"
        )

    names_gold = K.column_names(gold, ["task_id"]).withColumnRenamed("names", "gold_names")
    names_pred = K.column_names(pred, key).withColumnRenamed("names", "pred_names")
    verdict = verdict.join(names_gold, "task_id", "left").join(names_pred, key, "left")
    return _final(verdict)


def _relax(gold: DataFrame, pred: DataFrame, wide: DataFrame) -> DataFrame:
    key = ["run_id", "task_id"]
    if wide.isEmpty():  # relaxations are rare; most scorings need none of the steps below
        return wide.select(*key, F.lit(None).cast("string").alias("relaxed"))
    square_gold = K.signed(
        gold.join(wide.select("task_id", "gold_columns").distinct(), "task_id").select(
            "task_id", "row_pos", R.squared("gold_columns").alias("cells")
        )
    )
    square_pred = pred.join(wide.select(*key, "pred_columns"), key).select(
        *key, "row_pos", R.squared("pred_columns").alias("cells")
    )
    return R.try_mappings(
        square_gold,
        square_pred,
        wide.select(*key, "method_class", "gold_rows", "abs_tol", "rel_tol"),
    )


def _final(v: DataFrame) -> DataFrame:
    same = F.coalesce("same", F.lit(False))
    by_zero = ~same & F.coalesce("zero_count", F.lit(False))
    ambiguous = F.coalesce(F.col("relaxed") == "ambiguous", F.lit(False))
    by_columns = ~same & ~by_zero & ~ambiguous & (
        F.coalesce(F.col("relaxed") == "pass", F.lit(False))
        | F.coalesce(F.col("wants") == "pass", F.lit(False))
    )
    compared = F.col("label").isNull()
    lists = (F.col("gold_shape") == "list") & (F.col("pred_shape") == "list")
    empty = (F.col("gold_rows") == 0).cast("int") + (F.col("pred_rows") == 0).cast("int")
    column_match = (
        F.when(F.col("label").isin("missing_prediction", "missing_answer", "scoring_exception"), 0.0)
        .when(F.col("failed").isNotNull() & (F.col("label") != "rubric_pending"), 0.0)
        .when(F.coalesce(F.col("answer_type") == "Scalar", F.lit(False)), 1.0)
        .when(~F.coalesce(lists, F.lit(False)), 0.0)
        .when(empty == 2, 1.0)
        .when(empty == 1, 0.0)
        .otherwise(K.jaccard(F.col("gold_names"), F.col("pred_names")))
    )
    passed = F.when(
        F.col("label") == "rubric_pending", F.lit(None).cast("boolean")
    ).otherwise(compared & (same | by_zero | by_columns))
    counted = (compared | (F.col("label") == "format_error")) & F.col("pred_rows").isNotNull()
    zero = F.lit(0.0)
    metric = lambda c: F.when(compared, F.coalesce(c, zero)).otherwise(zero).alias(c)
    error = F.coalesce(F.col("label"), F.when(~same & ~by_zero & ambiguous, F.lit("ambiguous_column_mapping")))
    said = F.when(F.col("label") == F.col("failed"), F.col("failed_message"))
    known = set(v.columns)
    extra = lambda name, typ: (
        F.col(name).cast(typ) if name in known else F.lit(None).cast(typ)
    ).alias(name)
    return v.select(
        "run_id",
        "task_id",
        F.coalesce(extra("session_id", "string"), F.col("task_id")).alias("session_id"),
        F.coalesce(extra("turn_number", "int"), F.lit(1)).alias("turn_number"),
        passed.alias("passed"),
        passed.cast("double").alias("score"),
        F.coalesce(passed, F.lit(False)).alias("exact_match"),
        metric("row_f1"),
        metric("precision"),
        metric("recall"),
        F.coalesce(column_match, zero).alias("column_match"),
        error.alias("error_type"),
        F.coalesce(said, message(error, F.col("raw"), F.col("method_class"))).alias("error_message"),
        extra("expected_row_count", "long"),
        F.when(counted & (F.col("pred_shape") == "list"), F.col("pred_rows"))
        .when(counted & (F.col("answer_type") == "Scalar"), F.lit(1).cast("long"))
        .alias("predicted_row_count"),
        "answer_type",
        "scoring_method",
        extra("tier", "int"),
        extra("sql_difficulty", "string"),
        extra("primary_axis", "string"),
        extra("secondary_axis", "string"),
        extra("latency_seconds", "double"),
        extra("cost_usd", "double"),
        extra("tool_calls", "int"),
        F.coalesce(extra("generated_sql_present", "boolean"), F.lit(False)).alias(
            "generated_sql_present"
        ),
        F.coalesce(extra("sql_transpiled", "boolean"), F.lit(False)).alias("sql_transpiled"),
        (compared & by_columns).alias("extra_columns_relaxed"),
        (compared & by_zero).alias("empty_set_relaxed"),
    )
