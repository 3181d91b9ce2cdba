"""Choices of predicted columns against trying every mapping, and errors that stay with their task."""

import random
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from assayer.functions import cells as C
from assayer.operators import compare as K
from assayer.operators import grade as G
from assayer.operators import relax as R
from assayer.sources import answers as A

KEY = ["run_id", "task_id"]
CELLS = f"array<{C.CELL}>"


def relaxed(spark, cases):
    """``cases``: task -> (gold rows, predicted rows) of texts; task -> verdict."""
    cells = lambda row: [(f"c{i}", "str", v) for i, v in enumerate(row)]
    gold = [(t, cells(r)) for t, (g, _) in cases.items() for r in g]
    pred = [("r", t, cells(r)) for t, (_, p) in cases.items() for r in p]
    pairs = [("r", t, "set", len(g), C.ABS_TOL, C.REL_TOL) for t, (g, _) in cases.items()]
    empty = F.lit(None).cast("long")
    g = spark.createDataFrame(gold, f"task_id string, cells {CELLS}").withColumn("row_pos", empty)
    p = spark.createDataFrame(pred, f"run_id string, task_id string, cells {CELLS}").withColumn("row_pos", empty)
    pairs = spark.createDataFrame(pairs, "run_id string, task_id string, method_class string, gold_rows long, abs_tol double, rel_tol double")
    return {r.task_id: r.relaxed for r in R.try_mappings(K.signed(g), p, pairs).collect()}


def passes(gold, pred):
    want = Counter(tuple(sorted(r)) for r in gold)
    column = lambda rows, i: sorted(r[i] for r in rows)
    for picks in permutations(range(len(pred[0])), len(gold[0])):
        if all(column(gold, i) == column(pred, j) for i, j in enumerate(picks)):
            if {tuple(sorted(r[j] for j in picks)) for r in pred} == set(want):
                return True
    return False


def test_choices_equal_all_mappings(spark):
    r, cases = random.Random(11), {}
    for i in range(60):
        n, wide, rows = r.choice([1, 2, 3]), r.choice([3, 4, 5]), r.choice([1, 2, 3])
        pred = [[r.choice("ab") for _ in range(wide)] for _ in range(rows)]
        picks = r.sample(range(wide), n)
        gold = [[row[j] for j in picks] for row in pred]
        if i % 2:
            r.shuffle(flat := [v for row in gold for v in row])
            gold = [flat[k * n : k * n + n] for k in range(rows)]
        cases[f"t{i}"] = (gold, pred)
    want = {t: "pass" for t, (g, p) in cases.items() if passes(g, p)}
    assert 20 < len(want) < 60
    assert relaxed(spark, cases) == want


def test_many_equal_and_many_permuted_columns(spark):
    r = random.Random(5)
    equal = ([[str(i)] * 20 for i in range(30)], [[str(i)] * 40 for i in range(30)])
    columns = [r.sample([str(i) for i in range(40)], 40) for _ in range(16)]
    permuted = ([list(row) for row in zip(*columns[4:12])], [list(row) for row in zip(*columns)])
    a, b = "x", "y"
    unclear = ([[a] * 4 + [b] * 3, [b] * 4 + [a] * 3], [[a] * 2 + [b] * 6, [b] * 2 + [a] * 6])
    lacking = ([["1", "1"]], [["1", "2", "3"]])
    got = relaxed(spark, {"equal": equal, "permuted": permuted, "unclear": unclear, "lacking": lacking})
    assert got == {"equal": "pass", "permuted": "pass", "unclear": "ambiguous"}


def test_an_unreadable_answer_and_a_failure_fail_their_own_task_only(spark):
    answers = {
        "good": '{"answer": [{"a": 1}]}', "cut": '{"answer": [{"a": 1}', "twice": '{"answer": [{"a": 1, "a": 1}]}',
        "deep": '{"answer": ' + "[" * 3000 + "]" * 3000 + "}", "nan": '{"answer": [{"a": NaN}]}', "failed": '{"answer": [{"a": 1}]}',
        "rubric": '{"answer": [', "other_run": '{"answer": [{"a": 1}]}',
    }
    tasks = spark.createDataFrame([(t, "Rubric" if t == "rubric" else "Set-Match", "Rows", None) for t in answers],
                                  "task_id string, scoring_method string, answer_type string, value_tolerance string")
    gold = tasks.select("task_id", F.lit('{"answer": [{"a": 1}]}').alias("rec"))
    pred = spark.createDataFrame([("0", t, r) for t, r in answers.items()], "run_id string, task_id string, rec string")
    failures = spark.createDataFrame([(None, "failed", "broken", "it broke"), ("0", "failed", "late", "second"), ("1", "other_run", "broken", "elsewhere")],
                                     "run_id string, task_id string, error_type string, error_message string")
    scores = G.score_tasks(tasks, *A.parse_answers(gold, ["task_id"], ("answer",)), *A.parse_answers(pred, KEY), ["0"], failures=failures)
    got = {r.task_id: (r.passed, r.error_type, r.error_message) for r in scores.collect()}
    unread = (False, "scoring_exception", "Answer is no readable JSON")
    assert got == {
        "good": (True, None, None), "other_run": (True, None, None), "failed": (False, "broken", "it broke"),
        "rubric": (None, "rubric_pending", G.MESSAGES["rubric_pending"]), **dict.fromkeys(["cut", "twice", "deep", "nan"], unread),
    }
