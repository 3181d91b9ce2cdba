"""Planted leaks are found one by one, the clean tree stays clean, passages match brute force."""

import random

import pytest

from assayer.operators import leak as L

PUBLISHED = ["CB_T1_001_T1", "CB_MULTI_003_T1", "CB_MULTI_003_T2"]
CLEAN = [
    ("docs/NOTES.md", "See CB_T1_001_T1, its session CB_T1_001 and turn CB_T1_001_T1_T1."),
    ("sample/questions.json", '{"task_id":"CB_MULTI_003_T2","gold_sql":"SELECT 1"}'),
    ("eval/SCORING.md", "the field \"gold_sql\": is described here"),
    (".scratch/dump.json", '{"gold_sql":"x"}'),
    ("data/binary.bin", '{"gold_sql":"x"} CB_T9_999_T1'),
]
EXEMPT, BEARING, IGNORE = ["eval/SCORING.md"], ["sample/questions.json"], [".scratch/"]
HIDDEN = [f"CB_T{tier}_{number:03d}_T1" for tier, number in ((2, 17), (5, 404), (8, 1))]
PLANTED = [(f"notes/{i}.md", f"compare with ({h})", "unknown_ids") for i, h in enumerate(HIDDEN)]
PLANTED += [
    ("eval/SCORING.md", f"an exempt file may name fields, but not {HIDDEN[0]}", "unknown_ids"),
    ("notes/session.md", "CB_MULTI_008 was never published", "unknown_ids"),
    ("notes/next.md", "CB_MULTI_003_T5 follows the published turns", "unknown_ids"),
    ("notes/fields.yaml", '"gold_sql": "SELECT 2"', "sensitive_field"),
    ("notes/hash.json", '{"answer_sha256": "00ff"}', "sensitive_field"),
    ("notes/gold_answers/readme.md", "nothing here", "forbidden_path"),
    ("drafts/bench_questions_answers.txt", "nothing here", "forbidden_name"),
]


def scan(spark, files, published=PUBLISHED):
    docs = spark.createDataFrame(files, "doc string, text string")
    ids = spark.createDataFrame([(i,) for i in published], "id string")
    return L.scan(docs, ids, IGNORE, EXEMPT, BEARING).collect()


def test_clean_tree(spark):
    assert scan(spark, CLEAN) == []


def test_planted(spark):
    """Each planted file is found once, by its rule; files of the clean tree it replaces aside."""
    taken = {doc for doc, _, _ in PLANTED}
    found = scan(spark, [f for f in CLEAN if f[0] not in taken] + [(doc, text) for doc, text, _ in PLANTED])
    assert sorted((r["doc"], r["rule"]) for r in found) == sorted((doc, rule) for doc, _, rule in PLANTED)


def test_empty_allowlist_is_reported(spark):
    rules = {r["rule"] for r in scan(spark, [("a.md", "nothing")], [])}
    assert rules == {"allowlist_required"}


def test_first_five_are_shown(spark):
    text = " ".join(f"CB_T2_{i:03d}_T1" for i in range(8))
    (row,) = scan(spark, [("a.md", text)])
    assert row["detail"].startswith("8 unknown: CB_T2_000_T1, CB_T2_001_T1") and row["detail"].endswith("…")


@pytest.mark.parametrize(
    "pattern,name,hit",
    [("*.log", "a/b.log", True), ("tmp_?.md", "tmp_1.md", True), ("tmp_?.md", "tmp_12.md", False),
     ("[ab].txt", "x/a.txt", True), ("[!ab].txt", "x/a.txt", False), ("out/", "x/out/y", True)],
)
def test_ignore_patterns(spark, pattern, name, hit):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(name,)], "p string")
    assert df.select(L.ignored(F.col("p"), [pattern]).alias("i")).first()["i"] is hit


def test_passages_match_brute_force(spark):
    rng = random.Random(3)
    words = ["al", "be", "ce", "de", "eps", "zet"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60)) + rng.choice(["", "\n", ".  "]) + text(20)) for i in range(60)]
    items = [(i, text(rng.randint(1, 4))) for i in range(10)]
    for i in range(10, 30):  # cut anywhere, also inside words
        body = rng.choice(docs)[1]
        start = rng.randrange(max(1, len(body) - 5))
        items.append((i, body[start : start + rng.randint(3, 90)]))
    got = L.verbatim_passages(
        spark.createDataFrame(docs, "doc int, text string"),
        spark.createDataFrame(items, "item int, text string"),
    )
    want = {(d, i) for d, t in docs for i, p in items if p and p in t}
    assert {(r["doc"], r["item"]) for r in got.collect()} == want
