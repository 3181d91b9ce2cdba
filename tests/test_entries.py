"""Every broken entry is rejected, the good one and its variants are accepted."""

import copy
import json

import pytest

from assayer.operators import rules as R
from assayer.sources import entries as E
from assayer.sources.answers import InputError

GOOD = {
    "entry_id": "2026-01-15-a",
    "system": {"name": "a", "organization": "o", "open_source": True, "kind": "agent", "arm": "controlled", "url": None},
    "model": {"name": None, "access": "api", "temperature": 0.5},
    "protocol": {
        "split": "full", "corpus_version": "v1", "data_snapshot_id": "s1", "scorer_version": "v1",
        "runs": 3, "denominator": 190, "attempted": None, "evaluated_at": "2026-01-15T00:00:00Z",
    },
    "results": {
        "execution_accuracy": {"mean": 0.5, "std": 0.1, "runs": [0.4, 0.5, 0.6], "n": 95},
        "cost_usd_per_task": {"mean": None, "unavailable_reason": "not metered"},
        "by_tier": {"1": 0.5, "7": 1},
        "by_session": {"S1": {"turns_passed": 2, "turns_total": 4, "session_passed": False}},
    },
    "declarations": {"test_data_seen": False, "human_in_loop": False, "canary_check": None},
}


def broken(change):
    entry = copy.deepcopy(GOOD)
    change(entry)
    return entry


def put(*path):
    *parents, last, value = path

    def change(e):
        for p in parents:
            e = e[p]
        e[last] = value

    return change


def drop(*path):
    def change(e):
        for p in path[:-1]:
            e = e[p]
        del e[path[-1]]

    return change


def spoilt(field):
    """(what, value, rule) for every way to break one declared field by its own rule."""
    kinds = set(field.types)
    wrong = next(v for k, v in [("object", "text"), ("string", ["list"]), ("boolean", "maybe"), ("number", "many"), ("integer", 2.25)] if k in kinds)
    yield "type", wrong, "type"
    if field.enum:
        yield "enum", "none of these", "enum"
    if field.pattern:
        yield "pattern", "~", "pattern"
    if field.min_length:
        yield "length", "", "min_length"
    if field.minimum is not None:
        yield "minimum", field.minimum - 3, "minimum"
    if field.maximum is not None:
        yield "maximum", field.maximum + 3, "maximum"


def cases():
    for field in R.ENTRY_FIELDS:
        path = field.path.split(".")
        if not all(isinstance(p, str) and p for p in path) or "*" in field.path:
            continue
        for what, value, rule in spoilt(field):
            yield f"{field.path}:{what}", put(*path, value), rule
        if field.required:
            yield f"{field.path}:required", drop(*path), "required"


def metric(**fields):
    return put("results", "execution_accuracy", fields)


CASES = {name: (change, rule) for name, change, rule in cases()} | {
    "another file name": (put("entry_id", "2025-12-31-b"), "identity"),
    "mean off its runs": (metric(mean=0.31, runs=[0.2, 0.3, 0.4]), "mean_of_runs"),
    "fewer runs": (metric(mean=0.45, runs=[0.4, 0.5]), "run_count"),
    "empty mean, no word why": (metric(mean=None), "null_reason"),
    "undeclared": (put("model", "weight_gb", 3), "unexpected"),
    "undeclared in a metric": (metric(mean=0.3, median=0.3), "unexpected"),
    "no turns": (put("results", "by_session", "S1", "turns_total", -1), "minimum"),
}


def violations(spark, entries):
    """Rules broken by each of the named entries, in one pass over all of them."""
    rows = [(name, json.dumps(entry), "/r/2026-01-15-a.json") for name, entry in entries.items()]
    docs = spark.createDataFrame(rows, "row_id string, doc string, stem string")
    found = {name: set() for name in entries}
    for r in R.check_entries(docs, "stem").collect():
        found[r["row_id"]].add(r["rule"])
    return found


def test_broken_entries(spark):
    found = violations(spark, {"good": GOOD} | {name: broken(change) for name, (change, _) in CASES.items()})
    assert found["good"] == set()
    assert [name for name, (_, rule) in CASES.items() if rule not in found[name]] == []


def test_loader_refuses_a_bad_folder(spark, tmp_path):
    (tmp_path / "2026-01-15-a.json").write_text(json.dumps(GOOD))
    assert E.load_entries(spark, str(tmp_path)).first()["results"]["execution_accuracy"]["mean"] == 0.5
    (tmp_path / "2026-01-15-b.json").write_text(json.dumps(GOOD))
    with pytest.raises(InputError, match="violations of entries, all in"):
        E.load_entries(spark, str(tmp_path))


def test_every_violation_is_kept_whole(spark, tmp_path):
    long = "~" * 500
    for i in range(9):
        entry = broken(put("system", "kind", f"{long}{i}"))
        entry["entry_id"] = f"2026-01-15-{i}"
        (tmp_path / f"2026-01-15-{i}.json").write_text(json.dumps(entry))
    with pytest.raises(InputError) as refused:
        E.load_entries(spark, str(tmp_path))
    path = str(refused.value).split("all in ")[1].split(";")[0]
    found = [r["observed"] for r in spark.read.parquet(path).collect()]
    assert {f"{long}{i}" for i in range(9)} <= {f.strip('"') for f in found}


def test_all_rules_are_one_scan_and_one_parse(spark, tmp_path):
    spark.createDataFrame([("r", "{}")], "row_id string, doc string").write.parquet(str(tmp_path / "d"))
    found = R.check_entries(spark.read.parquet(str(tmp_path / "d")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
    assert {r.rule for r in found.collect()} == {"required"}
