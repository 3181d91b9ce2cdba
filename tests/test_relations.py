"""Properties of the comparison that hold for any answer."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import cells as C
from assayer.operators import compare as K
from assayer.operators import relax as R

ROWS = [("a", 1.5, 10), ("b", 2.25, 20), ("c", None, 30), ("a", 1.5, 40)]


def frame(spark, rows, names):
    kinds = ["string", "double", "bigint", "string"][: len(names)]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    return spark.createDataFrame(rows, schema)


def verdict(spark, gold, pred, match=K.set_match):
    g = K.signed(K.answer_rows(gold.withColumn("task_id", F.lit("t")), ["task_id"]))
    p = pred.withColumn("task_id", F.lit("t")).withColumn("run_id", F.lit("0"))
    p = K.signed(K.answer_rows(p, ["run_id", "task_id"]))
    pairs = spark.createDataFrame([("0", "t")], "run_id string, task_id string")
    return match(g, p, pairs).first()


@pytest.mark.parametrize("seed", range(3))
def test_order_and_names_do_not_matter(spark, seed):
    rng = random.Random(seed)
    rows = ROWS[:]
    rng.shuffle(rows)
    gold = frame(spark, ROWS, ["x", "y", "z"])
    pred = frame(spark, rows, ["p", "q", "r"])
    columns = pred.columns
    rng.shuffle(columns)
    out = verdict(spark, gold, pred.select(*columns))
    assert out["exact"] and out["row_f1"] == 1.0


def test_one_more_row_fails(spark):
    gold = frame(spark, ROWS, ["x", "y", "z"])
    pred = frame(spark, [*ROWS, ("new", 0.5, 1)], ["x", "y", "z"])
    out = verdict(spark, gold, pred)
    assert not out["exact"] and out["recall"] == 1.0 and out["precision"] == 0.8


def test_copies_count_only_in_the_multiset(spark):
    gold = frame(spark, ROWS, ["x", "y", "z"])
    pred = frame(spark, [*ROWS, ROWS[0]], ["x", "y", "z"])
    assert verdict(spark, gold, pred)["exact"]
    assert not verdict(spark, gold, pred, K.multiset_match)["exact"]


def choices(spark, pairs):
    rows = [("0", "t", g, f"g{g}", int(p[1:]), p) for g, p in pairs]
    schema = "run_id string, task_id string, gold_pos int, gold_col string, pred_pos int, pred_col string"
    return sorted(r.pred_cols for r in R.column_choices(spark.createDataFrame(rows, schema)).collect())


def test_many_equal_columns_are_one_choice(spark):
    every = [(g, f"c{i}") for g in range(9) for i in range(9)]  # 9! ways to assign them
    assert choices(spark, every) == [[f"c{i}" for i in range(9)]]


def test_choices_use_each_column_once(spark):
    assert choices(spark, [(0, "c0"), (0, "c1"), (1, "c0")]) == [["c0", "c1"]]
    assert choices(spark, [(0, "c0"), (1, "c0")]) == []
    assert choices(spark, [(0, "c0"), (0, "c1"), (1, "c1"), (1, "c2")]) == [["c0", "c1"], ["c0", "c2"], ["c1", "c2"]]


def matched(spark, gold, pred, abs_tol=1e-6, in_order=False):
    """Rows are tuples of texts and numbers."""
    def rows(side):
        out = []
        for pos, row in enumerate(side):
            cells = [("c", "null" if x is None else "num" if isinstance(x, (int, float)) else "str", None if x is None else str(x)) for x in row]
            out.append(("0", "t", pos, cells))
        schema = "run_id string, task_id string, row_pos long, cells array<struct<name:string,kind:string,text:string>>"
        return K.signed(spark.createDataFrame(out, schema))

    pairs = spark.createDataFrame(
        [("0", "t", len(gold), len(pred), abs_tol, 1e-9, in_order)],
        "run_id string, task_id string, gold_rows long, pred_rows long, abs_tol double, rel_tol double, in_order boolean",
    )
    return K.greedy_assignment(rows(gold).drop("run_id"), rows(pred), pairs).first()["matched"]


def test_each_row_is_used_once(spark):
    assert matched(spark, [(1.5,), (1.5,)], [(1.5,), (1.6,)]) == 1
    assert matched(spark, [(1.5,), (2,)], [(2.0,), ("1.50",)]) == 2
    assert matched(spark, [(33.33,)], [(33.333333,)], in_order=True) == 1
    assert matched(spark, [(33,)], [(33.4,)]) == 1 and matched(spark, [(33.0,)], [(33.4,)]) == 0
    assert matched(spark, [("a", 1.25)], [("b", 1.25)]) == 0 and matched(spark, [(None, 1)], [(1, None)]) == 1
    assert matched(spark, [], [(1,)]) == 0


def test_no_size_changes_the_answer(spark):
    for n in (500, 501, 3000):
        gold = [(f"k{i % 7}", round(i * 1.37, 2)) for i in range(n)]
        pred = [(k, v + 0.0004) for k, v in reversed(gold)]
        assert matched(spark, gold, pred) == n


def test_the_largest_number_may_be_another_cell(spark):
    assert matched(spark, [(10, 10.001)], [(10.3, 10.001)]) == 1
    assert matched(spark, [(10.001, 10, "x")], [("x", 10.001, 10.3)], in_order=True) == 1
    assert matched(spark, [(10, 10.001)], [(10.6, 10.001)]) == 0 and matched(spark, [(10, 10.001)], [(10.3, 10.1)]) == 0
    assert matched(spark, [(5, 5.25, 4.999)], [(5.4, 5.25, 4.999)]) == 1
    assert matched(spark, [(-1, -0.9999)], [(-0.6, -0.9999)]) == 1
    assert matched(spark, [(7, 123.4567)], [(7.2, 123.4567)]) == 1


def test_pruning_drops_no_pair_that_is_equal(spark):
    """Every pair of rows, judged with and without the cells."""
    rng = random.Random(11)
    number = lambda: round(rng.choice([-2, 0, 3, 10, 250]) + rng.random() * rng.choice([0, 1]), rng.randint(0, 4))
    for _ in range(3):
        rows = [tuple(rng.choice([int, float])(number()) for _ in range(3)) for _ in range(25)]
        gold = list({tuple(sorted(row)): row for row in rows}.values())  # rows of one signature are one class
        pred = [tuple(x + rng.choice([0, 0, 0.3, -0.3, 0.04, 0.0004]) for x in rng.sample(row, 3)) for row in gold]
        cells = lambda row: [("c", "num", str(x)) for x in row]
        schema = "run_id string, task_id string, row_pos long, cells array<struct<name:string,kind:string,text:string>>"
        g, p = (K.signed(spark.createDataFrame([("0", "t", i, cells(r)) for i, r in enumerate(side)], schema)) for side in (gold, pred))
        pairs = spark.createDataFrame([("0", "t", 1e-6, 1e-9, False)], "run_id string, task_id string, abs_tol double, rel_tol double, in_order boolean")
        got = {(r.g.sig, r.p.sig) for r in K.tolerant_edges(g.drop("run_id"), p, pairs).collect()}
        every = K.signed(g).select(F.col("sig").alias("a"), F.col("prep").alias("x")).crossJoin(K.signed(p).select(F.col("sig").alias("b"), F.col("prep").alias("y")))
        want = {(r.a, r.b) for r in every.where(C.rows_equal(F.col("x"), F.col("y"), F.lit(1e-6), F.lit(1e-9))).collect()}
        assert got == want


def test_chains_are_followed_in_order(spark):
    """Each number fits two others; the first takes the first, and so on."""
    gold, pred = [(float(i),) for i in range(6)], [(i + 0.5,) for i in range(-1, 5)]
    assert matched(spark, gold, pred, abs_tol=0.6, in_order=True) == 6
    assert matched(spark, [(1.0,), (1.0,), (2.0,)], [(1.0,), (1.0,), (1.0,)]) == 2
