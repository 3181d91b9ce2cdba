"""Ranks, positions and running totals whose groups may be larger than one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole key to one task, and a window
without keys sends the whole table there. The operators here sort with a range exchange, which
splits a large key over many tasks, then add up one small row per (range, key):

1. range-sort by (keys, order) and fix the result with a checkpoint, so that the range of a row
   can never change if a task is run again;
2. running value inside each (range, key);
3. value of the earlier ranges of the same key: at most one row per range, so the window over
   them is small whatever the data size;
4. the sum of both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import cut_lineage


def _as_order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column],
    total: bool = False,
) -> DataFrame:
    """Add, for every ``name: value`` of ``sums``, the sum over the key's rows up to this one.

    ``order`` has to be a total order inside a key for a repeatable answer. With ``total`` the
    sum over the whole key is added as ``<name>_total``.
    """
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", value)
    # "_copy" only separates rows that are equal in every order column, so that a pile of equal
    # rows can be cut by the range exchange as well.
    placed = (
        df.withColumn("_copy", F.monotonically_increasing_id())
        .orderBy(*[F.col(k) for k in keys], *_as_order(order), "_copy")
        .drop("_copy")
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed).withColumn("_range", F.shiftright("_place", 33))

    by_range = [*keys, "_range"]
    per_range = placed.groupBy(*by_range).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    )
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range")
    offsets = per_range.select(
        *by_range,
        *[
            F.coalesce(
                F.sum(f"_t_{n}").over(earlier.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias(f"_o_{n}")
            for n in sums
        ],
        *(
            [
                F.sum(f"_t_{n}")
                .over(Window.partitionBy(*(keys or [F.lit(0)])))
                .alias(f"{n}_total")
                for n in sums
            ]
            if total
            else []
        ),
    )
    inside = Window.partitionBy(*by_range).orderBy("_place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = placed.select(
        "*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in sums]
    )
    left, right = local.alias("l"), offsets.alias("o")
    same = F.col("l._range") == F.col("o._range")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    helper = {"_place", "_range"} | {f"_v_{n}" for n in sums}
    return left.join(right, same).select(
        *[F.col(f"l.{c}") for c in placed.columns if c not in helper],
        *[(F.col(f"l._l_{n}") + F.col(f"o._o_{n}")).alias(n) for n in sums],
        *([F.col(f"o.{n}_total") for n in sums] if total else []),
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], into: str = "row_pos"
) -> DataFrame:
    """``row_number()`` over (keys, order) without one task per key."""
    out = running_sum(df, keys, order, {into: F.lit(1).cast("long")})
    return out.withColumn(into, F.col(into).cast("long"))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    descending: bool = True,
    size: str | None = None,
) -> DataFrame:
    """Add ``rank`` and ``dense_rank`` of ``by`` inside ``keys`` (``size``: rows of the key).

    Both depend only on the distinct values and their counts, so rows are counted per value
    before anything is moved; ties of any size cost one row.
    """
    values = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    placed = running_sum(
        values,
        keys,
        [order],
        {"_upto": F.col("_n"), "dense_rank": F.lit(1).cast("long")},
        total=size is not None,
    ).select(
        *keys,
        by,
        (F.col("_upto") - F.col("_n") + 1).cast("long").alias("rank"),
        F.col("dense_rank").cast("long").alias("dense_rank"),
        *([F.col("_upto_total").cast("long").alias(size)] if size else []),
    )
    same = F.lit(True)
    left, right = df.alias("l"), placed.alias("r")
    for k in (*keys, by):
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).select(
        "l.*", "r.rank", "r.dense_rank", *([F.col(f"r.{size}")] if size else [])
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles per key, interpolated between the two values next to their position, and ``n``, the values counted.

    Values are counted first and sorted by ranges, so a key's values are in many tasks; a quantile picks the one or two
    (value, count) rows that cover its position. Nulls are not counted; a key without values has null quantiles.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sum(counted, keys, [value], {"_upto": F.col("_n")}, total=True)
    picks = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_upto_total") - 1)
        low, high, before = F.floor(at), F.ceil(at), F.col("_upto") - F.col("_n")
        covers = lambda position: (before <= position) & (position < F.col("_upto"))
        weight = F.when(covers(low), 1 - (at - low)).otherwise(0.0) + F.when(covers(high), at - low).otherwise(0.0)
        picks.append(F.when(covers(low) | covers(high), F.struct(weight.alias("w"), F.col(value).cast("double").alias("v"))).alias(name))
    of = lambda name: F.sum(F.col(f"{name}.w") * F.col(f"{name}.v")).alias(name)
    picked = placed.select(*keys, "_upto_total", *picks)
    found = picked.groupBy(*keys).agg(*[of(name) for name in shares], F.max("_upto_total").cast("long").alias("n"))
    every = df.select(*keys).distinct().alias("k")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"k.{k}").eqNullSafe(F.col(f"f.{k}"))
    return every.join(found.alias("f"), same, "left").select("k.*", *[F.col(f"f.{n}") for n in shares], F.coalesce("f.n", F.lit(0)).alias("n"))
