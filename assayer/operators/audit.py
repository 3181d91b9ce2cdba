"""Table audits: profiles, snapshot comparison, duplicates, lifecycles, replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.ordering import running_sum


def verdict_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed verdicts of two scorings by (old, new) value."""
    key = ["run_id", "task_id"]
    both = before.withColumnRenamed("passed", "b").join(
        after.withColumnRenamed("passed", "a"), key, "full_outer"
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return (
        both.where(~F.col("b").eqNullSafe(F.col("a")))
        .groupBy(text("b").alias("before"), text("a").alias("after"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _one_zero(c: Column, dtype: T.DataType) -> Column:
    """Negative zero reads as zero, as equality already says."""
    return c + F.lit(0.0) if isinstance(dtype, T.DoubleType) else c


def _wide(dtype: T.DataType) -> str:
    """Where values are added exactly: at their own scale, doubles and floats at twelve places."""
    if isinstance(dtype, T.DecimalType):
        return f"decimal(38,{dtype.scale})"
    return "decimal(38,12)" if isinstance(dtype, T.FractionalType) else "decimal(38,0)"


def profile(df: DataFrame, name: str, distinct: bool = True) -> DataFrame:
    """COUNT, COUNT DISTINCT, SUM, MIN, MAX per column as (table, column, stat, value).

    Sums are exact decimals so that two engines or two orders agree. Distinct counts group
    (column, value) pairs first: no row is multiplied by a chain of distinct aggregates.
    """
    df = df.select(*[_one_zero(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    aggs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        aggs.append(F.count(c).cast("string").alias(f"{f.name}|count"))
        if isinstance(f.dataType, T.NumericType):
            total = F.sum(c.cast(_wide(f.dataType)))
            aggs.append(total.cast("string").alias(f"{f.name}|sum"))
        if isinstance(f.dataType, (T.AtomicType,)) and not isinstance(f.dataType, T.BinaryType):
            aggs.append(F.min(c).cast("string").alias(f"{f.name}|min"))
            aggs.append(F.max(c).cast("string").alias(f"{f.name}|max"))
    wide = df.agg(*aggs)
    stats = F.explode(
        F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in wide.columns])
    )
    long = wide.select(stats.alias("s")).select(
        F.lit(name).alias("table"),
        F.substring_index("s.k", "|", 1).alias("column"),
        F.substring_index("s.k", "|", -1).alias("stat"),
        F.col("s.v").alias("value"),
    )
    if not distinct:
        return long
    counts = distinct_counts(df).select(
        F.lit(name).alias("table"),
        "column",
        F.lit("count_distinct").alias("stat"),
        F.col("n_distinct").cast("string").alias("value"),
    )
    return long.unionByName(counts)


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact distinct values per column in one pass over (column, value) pairs."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                for c in df.columns
            ]
        )
    )
    return (
        df.select(pairs.alias("p"))
        .select("p.*")
        .distinct()
        .groupBy("column")
        .agg(F.count("value").alias("n_distinct"))
    )


def snapshot_equivalence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differing statistics of two profiles (table, column, stat, value)."""
    key = ["table", "column", "stat"]
    return (
        left.withColumnRenamed("value", "left_value")
        .join(right.withColumnRenamed("value", "right_value"), key, "full_outer")
        .where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    )


def row_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found more often on one side, with the surplus count; one shuffle for both ways.

    Copies are counted before they are moved, so a pile of equal rows costs one row.
    """
    columns = left.columns
    side = left.withColumn("_w", F.lit(1)).unionByName(right.withColumn("_w", F.lit(-1)))
    return (
        side.groupBy(*columns)
        .agg(F.sum("_w").alias("_d"))
        .where("_d <> 0")
        .select(
            *columns,
            F.when(F.col("_d") > 0, "left").otherwise("right").alias("only_in"),
            F.abs("_d").alias("copies"),
        )
    )


def changed_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of a keyed table that differ between two snapshots, with the rows they differ in."""
    columns = [c for c in left.columns if c not in keys]
    l, r = left.alias("l"), right.alias("r")
    both = l.join(r, keys)
    counts = both.agg(
        *[
            F.count_if(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(c)
            for c in columns
        ]
    )
    return counts.unpivot([], columns, "column", "rows_changed").where("rows_changed > 0")


def business_key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicated_groups"),
        F.sum(F.col("n") - 1).alias("excess_rows"),
    )


def distinct_per_segment(df: DataFrame, segment: str, value: str) -> DataFrame:
    """Rows and distinct values per segment; (segment, value) pairs are grouped first, so one
    large segment is counted by many tasks."""
    pairs = df.groupBy(segment, value).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(segment).agg(
        F.sum("n").alias("rows"),
        F.count(value).alias("n_distinct"),
        (F.count(value) <= 1).alias("degenerate"),
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one value; min equal to max decides, without any shuffle of values."""
    aggs = []
    for c in df.columns:
        aggs.append(F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(False)).alias(c))
    flags = df.agg(*aggs)
    return flags.unpivot([], df.columns, "column", "constant").where("constant").select("column")


def pair_correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    r = df.agg(F.corr(left, right).alias("correlation"))
    return r.withColumn("degenerate", F.abs(F.abs("correlation") - 1) < 1e-12)


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child key values without a parent and how many rows carry them."""
    keys = (
        child.where(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def lifecycle(df: DataFrame, day: Column, start: Column, end: Column, keys: list) -> DataFrame:
    """Facts before the start and after the end of their dimension row."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(day < start).alias("before_start"),
        F.count_if(day > end).alias("after_end"),
    )


def replay(df: DataFrame, stored: Column, rule: Column, tolerance: float, keys: list) -> DataFrame:
    """Recompute a column from a rule and count the rows whose stored value disagrees."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(stored - rule) > F.lit(tolerance)).alias("disagree"),
    )


def rate_by_snapshot(snapshots: dict[str, DataFrame], condition: Column) -> DataFrame:
    """Share of rows meeting a condition in each named snapshot."""
    parts = [
        df.agg(
            F.lit(name).alias("snapshot"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(condition).alias("met"),
        )
        for name, df in snapshots.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("share", F.col("met") / F.col("n_rows"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient. Equal values share the mean of their positions, which gives the same sum,
    so only (value, count) pairs are ordered, and that without a one-task window."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = running_sum(counted, [], [F.col(value)], {"upto": F.col("n")})
    x = F.col(value).cast("double")
    position = (F.col("upto") * 2 - F.col("n") + 1).cast("double")
    total = upto.agg(F.sum("n").alias("n"), F.sum(x * F.col("n")).alias("sx"), F.sum(x * position * F.col("n")).alias("two_six"))
    g = F.col("two_six") / (F.col("n") * F.col("sx")) - (F.col("n") + 1) / F.col("n")
    return total.select(F.col("n"), g.alias("gini"))
