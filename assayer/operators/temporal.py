"""Effective-dated lookups, as-of joins and point-in-time dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_lookup(
    facts: DataFrame,
    rules: DataFrame,
    equal: Sequence[str],
    day: str,
    start: str = "effective_from",
    end: str = "effective_to",
) -> DataFrame:
    """Rule in force on the fact's day, matched on the equal columns as well.

    The rule table joins by plain equality plus a range filter; Catalyst broadcasts it when its
    size is under the session's threshold and shuffles on the equal columns otherwise.
    """
    f, r = facts.alias("f"), rules.alias("r")
    on = (F.col(f"f.{day}") >= F.col(f"r.{start}")) & (
        F.col(f"f.{day}") <= F.coalesce(F.col(f"r.{end}"), F.lit("9999-12-31").cast("date"))
    )
    for c in equal:
        on = on & (F.col(f"f.{c}") == F.col(f"r.{c}"))
    keep = [F.col(f"r.{c}") for c in rules.columns if c not in equal]
    return f.join(r, on, "left").select("f.*", *keep)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    bucket: Column,
    into: str,
) -> DataFrame:
    """Latest ``value`` of ``right`` at or before ``time`` of each row of ``left``.

    Both sides are cut into (key, bucket) slices; a slice is sorted alone, and the last value of
    earlier slices is carried in from one row per slice. A key that holds a third of all rows is
    thereby spread over its buckets. ``bucket`` is an expression over ``time`` that grows with it.
    Of several values at one time the largest is taken. Rows of ``left`` without a key or a time stay
    and get no value.
    """
    slice_ = "_slice"
    points = right.dropna(subset=[*keys, time]).groupBy(*keys, time).agg(F.max(value).alias("_value"))
    lasts = (
        points.withColumn(slice_, bucket)
        .groupBy(*keys, slice_)
        .agg(F.max_by("_value", time).alias("_last"))
    )
    events = (
        left.withColumn(slice_, bucket)
        .select(*keys, slice_, time, F.struct(*left.columns).alias("_row"))
        .withColumn("_value", F.lit(None).cast(points.schema["_value"].dataType))
        .withColumn("_side", F.lit(1))
        .unionByName(
            points.withColumn(slice_, bucket).withColumn("_side", F.lit(0)), allowMissingColumns=True
        )
    )
    inside = Window.partitionBy(*keys, slice_).orderBy(time, "_side")
    filled = events.withColumn("_here", F.last("_value", ignorenulls=True).over(inside)).where(
        "_side = 1"
    )
    # one row per slice of either side, so the window over a key is as long as its buckets
    slices = (
        filled.select(*keys, slice_)
        .distinct()
        .withColumn("_last", F.lit(None).cast(points.schema["_value"].dataType))
        .unionByName(lasts)
        .groupBy(*keys, slice_)
        .agg(F.max("_last").alias("_last"))
    )
    before = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(
        *keys, slice_, F.last("_last", ignorenulls=True).over(before).alias("_carried")
    )
    a, b = filled.alias("a"), carried.alias("b")
    same = F.lit(True)
    for c in (*keys, slice_):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").select(
        "a._row.*", F.coalesce("a._here", "b._carried").alias(into)
    )


def current_rows(dim: DataFrame) -> DataFrame:
    return dim.where("is_current")


def rows_at(dim: DataFrame, day: Column) -> DataFrame:
    """Dimension rows valid on a day; an open or unreadable end is open."""
    end = F.col("effective_to").try_cast("date")
    return dim.where((F.col("effective_from") <= day) & (end.isNull() | (end >= day)))
