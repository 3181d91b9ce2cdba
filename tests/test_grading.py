"""Verdicts of the whole pipeline on JSON answers of every shape."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import grade
from assayer.sources import answers as A

R = [{"a": "Banker", "n": 200}, {"a": "Web", "n": 33.33}]
CASES = [
    # name, method, answer type, gold, prediction, passed, error, flags
    ("scalar", "Scalar-Match", "Scalar", 117, 117, True, None, ""),
    ("scalar_row", "Scalar-Match", "Scalar", 117, [{"c": 117}], True, None, ""),
    ("scalar_text", "Exact", "Scalar", 117, "117.0", True, None, ""),
    ("scalar_bool", "Exact", "Scalar", True, 1, True, None, ""),
    ("scalar_key", "Exact", "Scalar", 5, {"value": 5, "note": "x"}, True, None, ""),
    ("scalar_wrong", "Exact", "Scalar", 117, 118, False, None, ""),
    ("scalar_places", "Exact", "Scalar", 33.3, 33.34, True, None, ""),
    ("scalar_extra", "Exact", "Scalar", 117, [{"x": 1, "y": 117}], True, None, "c"),
    ("alias", "Set-Match", "Rows", R, [{"b": 200, "z": "banker"}, {"z": "WEB ", "b": 33.333333}], True, None, ""),
    ("wrong", "Set-Match", "Rows", R, [{"a": "Banker", "n": 200}, {"a": "Web", "n": 33.35}], False, None, ""),
    ("copies", "Set-Match", "Rows", R, [R[0], R[0], R[1]], True, None, ""),
    ("missing_row", "Set-Match", "Rows", R, R[:1], False, None, ""),
    ("extra", "Set-Match", "Rows", R, [dict(r, k=i) for i, r in enumerate(R)], True, None, "c"),
    ("extra_wrong", "Set-Match", "Rows", R, [dict(r, k=i, a="q") for i, r in enumerate(R)], False, None, ""),
    ("ordered", "Ordered-List-Match", "Rows", R, R, True, None, ""),
    ("ordered_swapped", "Ordered-List-Match", "Rows", R, R[::-1], False, None, ""),
    ("ordered_extra", "Ordered-List-Match", "Rows", R, [dict(k=i, **r) for i, r in enumerate(R)], True, None, "c"),
    ("wrapped", "Set-Match", "Rows", R, {"rows": R}, True, None, ""),
    ("empty_ok", "Exact", "Rows", [], [], True, None, ""),
    ("empty_zero", "Exact", "Rows", [], [{"n": "0"}], True, None, "e"),
    ("empty_no", "Exact", "Rows", [], [["no"]], False, None, ""),
    ("empty_false", "Exact", "Rows", [], [{"n": False}], False, None, ""),
    ("empty_null", "Exact", "Rows", [], None, False, "empty_prediction", ""),
    ("blank", "Exact", "Rows", R, "", False, "empty_prediction", ""),
    ("text", "Exact", "Rows", R, "some text", False, "format_error", ""),
    ("dates", "Value-Match", "Rows", [{"d": "2026-03-10"}], [{"d": "2026-03-10T00:00:00"}], True, None, ""),
    ("times", "Value-Match", "Rows", [{"d": "2026-03-10"}], [{"d": "2026-03-10T00:00:01"}], False, None, ""),
    ("curly", "Set-Match", "Rows", [{"d": "don't  stop"}], [{"d": "don’t stop"}], True, None, ""),
    ("rubric", "Rubric", "Rows", R, R, None, "rubric_pending", ""),
    ("list", "Set-Match", "Rows", [1, 2], [{"v": 2}, {"v": 1.0}], True, None, ""),
]


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("grading")
    (folder / "gold").mkdir()
    tasks, preds = [], []
    for name, method, kind, gold, pred, *_ in CASES:
        tasks.append(
            {
                "task_id": name,
                "tier": 1,
                "turns": [
                    {
                        "turn_number": 1,
                        "ground_truth": {
                            "gold_answer_path": f"x/{name}.json",
                            "gold_answer_type": kind,
                            "scoring_method": method,
                        },
                    }
                ],
            }
        )
        (folder / "gold" / f"{name}.json").write_text(json.dumps({"task_id": name, "answer": gold}))
        preds.append({"task_id": name, "predicted_answer": pred, "generated_sql": "SELECT 1"})
    tasks.append(dict(tasks[8], task_id="not_sent"))
    tasks.append(dict(tasks[8], task_id="no_field"))
    preds.append({"task_id": "no_field"})
    (folder / "tasks.json").write_text(json.dumps({"tasks": tasks}))
    (folder / "run0.json").write_text(json.dumps({"predictions": preds}))
    t = A.load_tasks(spark, str(folder / "tasks.json"))
    g = A.load_gold(spark, str(folder / "gold"), t)
    p = A.load_predictions(spark, str(folder / "run0.json")).withColumn(
        "task_id", F.get_json_object("rec", "$.task_id")
    )
    gh, gr = A.parse_answers(g, ["task_id"], ("answer",))
    ph, pr = A.parse_answers(p, ["run_id", "task_id"])
    ph = ph.join(A.prediction_fields(p), ["run_id", "task_id"])
    out = grade.score_tasks(t, gh, gr, ph, pr, ["run0"])
    return {r["task_id"]: r.asDict() for r in out.collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_verdict(scored, case):
    name, *_, passed, error, flags = case
    row = scored[name]
    assert row["passed"] is passed
    assert row["error_type"] == error
    assert row["extra_columns_relaxed"] == ("c" in flags)
    assert row["empty_set_relaxed"] == ("e" in flags)


def test_rows_without_an_answer(scored):
    assert scored["not_sent"]["error_type"] == "missing_prediction"
    assert scored["no_field"]["error_type"] == "missing_answer"
    assert scored["not_sent"]["passed"] is False


def test_metrics_keep_the_penalty(scored):
    assert scored["extra"]["row_f1"] == 0.0
    assert scored["extra"]["column_match"] == pytest.approx(2 / 3)
    assert scored["missing_row"]["recall"] == 0.5
    assert scored["missing_row"]["precision"] == 1.0
    assert scored["wrong"]["precision"] == 0.5
    assert scored["copies"]["row_f1"] == 1.0


def test_errors_of_runs_with_text_ids(spark):
    from assayer.operators import rollup as U

    rows = [("run10", "t", "a"), ("run9", "t", "b"), ("10", "u", "x"), ("9", "u", "y"), ("9", "v", "x"), ("10", "v", "z"), ("11", "v", "z")]
    got = {r.task_id: r.error_type for r in U.representative_error(spark.createDataFrame(rows, "run_id string, task_id string, error_type string")).collect()}
    assert got == {"t": "a", "u": "y", "v": "z"}


def test_as_of_keeps_rows_without_key_or_time(spark):
    from pyspark.sql import functions as F

    from assayer.operators import temporal as Tm

    left = spark.createDataFrame([(1, 5, "a"), (None, 5, "b"), (1, None, "c"), (2, 5, "d")], "k int, t int, n string")
    right = spark.createDataFrame([(1, 3, 7.0), (1, 9, 8.0), (None, 1, 9.0), (1, None, 1.0)], "k int, t int, v double")
    out = Tm.as_of(left, right, ["k"], "t", "v", F.floor(F.col("t") / 4), "last").collect()
    assert sorted((r.n, r["last"]) for r in out if r["last"] is not None) == [("a", 7.0)]
    assert sorted(r.n for r in out) == ["a", "b", "c", "d"]
