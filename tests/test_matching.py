"""Tolerant one-to-one matching against a plain loop over rows."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assayer.functions import cells as C
from assayer.operators import compare as K

KEY = ["run_id", "task_id"]


def greedy(gold, pred, tol):
    """Gold rows in order, each taking the first predicted row that is left and fits."""
    left, matched = list(pred), 0
    for g in gold:
        places = max(0, -Decimal(g).as_tuple().exponent)
        fit = next((p for p in left if abs(Decimal(g) - round(Decimal(p), places)) <= Decimal(tol)), None)
        if fit is not None:
            left.remove(fit)
            matched += 1
    return matched


def matched(spark, gold, pred, tol, in_order=True):
    """``gold``: task -> number texts; ``pred``: (run, task) -> number texts."""
    g = spark.createDataFrame([(t, i, v) for t, vs in gold.items() for i, v in enumerate(vs)], "task_id string, pos long, v string")
    p = [(r, t, i, float(v)) for (r, t), vs in pred.items() for i, v in enumerate(vs)]
    p = spark.createDataFrame(p, "run_id string, task_id string, pos long, v double")
    pairs = spark.createDataFrame([(r, t, len(gold[t]), len(vs), tol, 0.0, in_order) for (r, t), vs in pred.items()],
                                  "run_id string, task_id string, gold_rows long, pred_rows long, abs_tol double, rel_tol double, in_order boolean")
    out = K.greedy_assignment(K.answer_rows(g, ["task_id"], order="pos"), K.answer_rows(p, KEY, order="pos"), pairs)
    return {(r.run_id, r.task_id): r.matched for r in out.collect()}


@pytest.mark.parametrize(("tol", "sequential"), [(0.0, 200_000), (2.5, 200_000), (2.5, 3)])
def test_any_overlap_equals_the_loop(spark, monkeypatch, tol, sequential):
    monkeypatch.setattr(K, "SEQUENTIAL", sequential)
    r = random.Random(7)
    number = lambda: str(r.choice([r.randrange(12), round(r.uniform(0, 12), 1), round(r.uniform(0, 12), 3)]))
    # each value once, so that rows are classes
    some = lambda sizes: list({Decimal(v): v for v in ["77", *(number() for _ in range(r.choice(sizes)))]}.values())[::-1]
    gold = {f"t{i}": some([1, 4, 15]) for i in range(6)}
    pred = {(run, t): some([0, 3, 15]) for run in "ab" for t in gold}
    assert matched(spark, gold, pred, tol) == {k: greedy(gold[k[1]], v, tol) for k, v in pred.items()}


def test_many_copies_against_many_partners_take_few_jobs(spark):
    n = 100_000
    frame = spark.range(n)
    gold = K.answer_rows(frame.select(F.lit("t").alias("task_id"), F.lit(10).cast("long").alias("v")), ["task_id"])
    amount = (F.lit("10.001").cast("decimal(12,9)") + F.col("id") * F.lit("0.00000399").cast("decimal(12,9)")).cast("decimal(12,9)")
    pred = K.answer_rows(frame.select(F.lit("r").alias("run_id"), F.lit("t").alias("task_id"), amount.alias("v")), KEY)
    pairs = spark.createDataFrame([("r", "t", n, n, C.ABS_TOL, C.REL_TOL, False)],
                                  "run_id string, task_id string, gold_rows long, pred_rows long, abs_tol double, rel_tol double, in_order boolean")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many-copies", "one gold class")
    try:
        assert K.greedy_assignment(gold, pred, pairs).first().matched == n
        assert len(tracker.getJobIdsForGroup("many-copies")) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_do_not_move_to_meet_few_pairs(spark, capsys):
    rows = spark.range(1000).select((F.col("id") % 2).cast("string").alias("run_id"), (F.col("id") % 2).cast("string").alias("task_id"), (F.col("id") % 7).alias("v"))
    pairs = [(i, i, C.ABS_TOL, C.REL_TOL, False) for i in "01"]
    pairs = spark.createDataFrame(pairs, "run_id string, task_id string, abs_tol double, rel_tol double, in_order boolean")
    pairs = pairs.localCheckpoint()  # of unknown size to the planner
    edges = K.tolerant_edges(K.answer_rows(rows.drop("run_id"), ["task_id"]), K.answer_rows(rows, KEY), pairs)
    assert {(r.g_left, r.p_left) for r in edges.collect()} == {(71, 71), (72, 72)}
    edges.explain()
    semi = [line for line in capsys.readouterr().out.splitlines() if "LeftSemi" in line]
    assert len(semi) >= 2 and all("BroadcastHashJoin" in line for line in semi)


PAIRS = "run_id string, task_id string, abs_tol double, rel_tol double, in_order boolean"


def test_rows_are_counted_by_hash_before_they_are_prepared(spark, capsys):
    rows = spark.range(1000).select(F.lit("0").alias("run_id"), F.lit("t").alias("task_id"), (F.col("id") % 7).cast("decimal(12,4)").alias("v"))
    pairs = spark.createDataFrame([("0", "t", C.ABS_TOL, C.REL_TOL, False)], PAIRS)
    K.tolerant_edges(K.answer_rows(rows.drop("run_id"), ["task_id"]), K.answer_rows(rows, KEY), pairs).explain()
    counts = [line for line in capsys.readouterr().out.splitlines() if "partial_count(1)" in line]
    assert len(counts) == 2 and all("HashAggregate" in line for line in counts)


def test_gold_classes_without_a_rival_need_no_order(spark, monkeypatch):
    """25 copies of 10 and 30 of 20 against 40 numbers near the first and 20 near the second."""
    monkeypatch.setattr(K, "_stretches", lambda edges: pytest.fail("nothing is left for it"))
    gold = {"t": ["10"] * 25 + ["20"] * 30}
    pred = {("a", "t"): [str(10 + i / 100) for i in range(40)] + [str(20 - i / 100) for i in range(20)], ("b", "t"): ["20.1"] * 31}
    assert matched(spark, gold, pred, 0.0) == {("a", "t"): 45, ("b", "t"): 30}


def test_a_rival_anywhere_keeps_the_order(spark):
    """0 and 1 both fit 0.6; 50 is alone."""
    gold, pred = {"t": ["0", "1", "1.5", "50"]}, {("a", "t"): ["0.6", "1.0", "1.4", "50.2", "49.9"]}
    assert matched(spark, gold, pred, 1.0) == {k: greedy(gold["t"], v, 1.0) for k, v in pred.items()}


def test_kept_cells_and_places_give_the_prepared_cells(spark):
    number = [0, 1, -1, 10, 100, 12345, 10**8]
    rows = [
        (n, n / 7, n * 1e20, Decimal(n) / 1000, Decimal(n).scaleb(-9), Decimal(n) * 10**25, f" {n}e1 ", bytes(str(n), "ascii"), n > 0, datetime.date(2020, 1, 1))
        for n in number
    ]
    rows += [(None,) * 10, (5, 0.0, -0.5, Decimal("-0.050"), Decimal("1E-9"), Decimal(-7), "NaN", b"7x", False, None)]
    schema = "i long, d double, e double, f decimal(12,3), g decimal(20,9), h decimal(38,0), s string, b binary, o boolean, t date"
    df = K.answer_rows(spark.createDataFrame(rows, schema), [])
    low = lambda prep: F.transform(prep, lambda c: c.withField("low", F.lower(c["low"])))
    again = C.prepare_again(F.col("cells"), F.col("prep")["places"])
    found = df.select(low(F.col("prep")).alias("prep"), low(again).alias("again"), low(C.prepare(F.col("cells"))).alias("parsed")).collect()
    assert [r.again for r in found] == [r.prep for r in found]
    assert [r.parsed[3:6] for r in found] == [r.prep[3:6] for r in found]  # decimal columns, which are not parsed from text
