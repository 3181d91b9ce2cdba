"""Distributed ranks and running totals against plain windows, with one dominant key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.operators.audit import gini
from assayer.operators.ordering import numbered, ranked, running_sum
from assayer.operators.temporal import as_of


def skewed(spark):
    k = F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise((F.col("id") % 7).cast("string"))
    value = F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 11)
    return spark.range(3000).select("id", k.alias("k"), value.alias("v"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_numbered(spark):
    df = skewed(spark)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
    got = numbered(df, ["k"], ["v", "id"], into="n")
    assert rows(got, "id", "n") == rows(want, "id", "n")


def test_ranked(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy(F.desc("v"))
    want = df.withColumn("r", F.rank().over(w)).withColumn("d", F.dense_rank().over(w))
    got = ranked(df, ["k"], "v")
    assert rows(got, "id", "rank", "dense_rank") == rows(want, "id", "r", "d")


def test_running_sum_without_keys(spark):
    df = skewed(spark)
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("v").over(w))
    got = running_sum(df, [], ["id"], {"s": F.col("v")}, total=True)
    assert rows(got, "id", "s") == rows(want, "id", "s")
    assert got.select("s_total").distinct().count() == 1


def test_equal_rows_are_all_numbered(spark):
    df = spark.range(1000).select(F.lit("same").alias("k"), F.lit(1).alias("v"))
    got = numbered(df, ["k"], ["v"], into="n")
    assert [r["n"] for r in got.orderBy("n").collect()] == list(range(1, 1001))


def test_gini_with_ties(spark):
    xs = [1, 1, 2, 5, 5, 9]
    n = len(xs)
    want = 2 * sum((i + 1) * x for i, x in enumerate(xs)) / (n * sum(xs)) - (n + 1) / n
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert abs(gini(df, "x").first()["gini"] - want) < 1e-12


def test_as_of_carries_over_empty_buckets(spark):
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 25, 11.0), ("b", 40, 3.0)], "k string, t int, v double")
    left = spark.createDataFrame(
        [("a", 0), ("a", 1), ("a", 24), ("a", 25), ("a", 95), ("b", 39), ("c", 5)], "k string, t int"
    )
    out = as_of(left, right, ["k"], "t", "v", F.expr("t div 10"), "price")
    got = {(r["k"], r["t"]): r["price"] for r in out.collect()}
    assert got == {
        ("a", 0): None, ("a", 1): 10.0, ("a", 24): 10.0, ("a", 25): 11.0, ("a", 95): 11.0,
        ("b", 39): None, ("c", 5): None,
    }


def test_quantiles_of_uneven_groups(spark):
    import numpy as np

    from assayer.operators.ordering import quantiles

    r = np.random.default_rng(4)
    groups = {"hot": r.integers(0, 7, 500), "even": r.normal(size=40), "one": np.array([3.5]), None: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    shares = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q10": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {x.k: x for x in quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == {*groups, "none"} and got["none"].n == 0 and got["none"].q2 is None
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        assert np.allclose([got[k][s] for s in shares], np.quantile(vs, list(shares.values())))


def test_chains_of_deep_trees_and_loops(spark):
    from assayer.operators.families import chain_paths

    deep = [(i, i - 1 if i else None, f"n{i}") for i in range(200)]
    rows = deep + [(1000, 1001, "a"), (1001, 1000, "b"), (1002, 1002, "self"), (1003, 1000, "below"), (1004, 77777, "lost"), (2000, None, "root")]
    got = {x.id: x.chain for x in chain_paths(spark.createDataFrame(rows, "id long, up long, name string"), "id", "up", "name").collect()}
    assert set(got) == {*range(200), 2000}
    assert all(got[i] == " > ".join(f"n{k}" for k in range(i + 1)) for i in range(200))
    assert chain_paths(spark.createDataFrame([], "id long, up long, name string"), "id", "up", "name").collect() == []
