"""Warehouse query families, parameterised by frames and column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.ordering import numbered, ranked
from assayer.session import cut_lineage


def active_in_roles(df: DataFrame, active: Column, role: str, roles: Sequence[str]) -> DataFrame:
    return df.where(active & F.col(role).isin(*roles)).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, by: Column, ties: Column, k: int) -> DataFrame:
    """The k first rows with a fixed tie-break; each task keeps at most k rows."""
    return df.orderBy(by, ties).limit(k)


def top_members(
    members: DataFrame, owners: DataFrame, key: str, owner_key: str, code: str, k: int
) -> DataFrame:
    """Owners with the most members; members are counted before they meet their owners."""
    counted = members.groupBy(F.col(key).alias(owner_key)).agg(F.count(F.lit(1)).alias("members"))
    joined = owners.join(counted, owner_key)
    return top_k(joined, F.col("members").desc(), F.col(code).asc(), k)


def rollup_ranked(df: DataFrame, levels: Sequence[str], value: Column) -> DataFrame:
    """Sums at every roll-up level; the detail level is ranked inside the level above it."""
    return df.rollup(*levels).agg(
        F.grouping_id().alias("level"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")
    )


def chain_paths(members: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Names from the root to every member joined by ' > ', by pointer doubling.

    A row has the names down from below the ancestor that it points to. Each step joins rows with those of that ancestor, which doubles
    the levels a row has behind it: 2^k levels end in k joins. Members of a loop or below an unknown parent never point
    to nothing and are left out, as in a recursive query that starts at the roots; the steps end
    when one brings no member to its root, since then no other has one.
    """
    rows = members.select(
        F.col(key).alias("id"),
        F.col(parent).cast(members.schema[key].dataType).alias("up"),
        F.col(name).cast("string").alias("chain"),
    )
    rows = cut_lineage(rows)
    while not rows.where("up is not null").isEmpty():
        upper = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("chain").alias("above"))
        moved = rows.join(upper, "up").select(
            "id", F.col("next").alias("up"), F.concat("above", F.lit(" > "), "chain").alias("chain")
        )
        moved = cut_lineage(moved)
        rows = cut_lineage(rows.where("up is null").unionByName(moved))
        if moved.where("up is null").isEmpty():
            break
    return rows.where("up is null").select(F.col("id").alias(key), "chain")


def running_by_day(df: DataFrame, keys: Sequence[str], day: Column, value: Column) -> DataFrame:
    """Running total per day: sums per day first, so a key has as many rows as it has days."""
    daily = df.groupBy(*keys, day.alias("day")).agg(F.sum(value).alias("amount"))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("running", F.sum("amount").over(w))


def rank_within(df: DataFrame, group: str, by: str) -> DataFrame:
    return ranked(df, [group], by)


def percentile_bands(df: DataFrame, group: str, by: str, ties: str, bands: int) -> DataFrame:
    """``ntile`` and ``percent_rank`` inside groups of any size."""
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(df, [group], [F.col(by), F.col(ties)], into="_pos")
    with_rank = ranked(placed, [group], by, descending=False).join(total, group)
    size, extra = F.expr(f"_n div {bands}"), F.col("_n") % bands
    cut = extra * (size + 1)
    tile = F.when(F.col("_pos") <= cut, F.ceil(F.col("_pos") / (size + 1))).otherwise(
        extra + F.ceil((F.col("_pos") - cut) / F.greatest(size, F.lit(1)))
    )
    share = F.when(F.col("_n") > 1, (F.col("rank") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return with_rank.select(
        *df.columns, tile.cast("long").alias("band"), share.alias("percent_rank")
    )


def period_change(daily: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Previous period, change and a moving mean over a series with one row per (key, period)."""
    w = Window.partitionBy(*keys).orderBy(period)
    previous = F.lag(value).over(w)
    return daily.select(
        *keys,
        period,
        value,
        previous.alias("previous"),
        (F.col(value) - previous).alias("change"),
        F.avg(value).over(w.rowsBetween(-2, 0)).alias("moving_mean"),
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last row per key by a max over a struct: combined before the shuffle, no sort."""
    last = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}") for c in columns])


def allocation_drift(
    actual: DataFrame, target: DataFrame, owner: str, bucket: str, value: str
) -> DataFrame:
    """Actual weight per (owner, bucket) against its target band."""
    parts = actual.groupBy(owner, bucket).agg(F.sum(value).alias("amount"))
    whole = Window.partitionBy(owner)  # a row per bucket, so the window is tiny
    weight = (F.col("amount") / F.sum("amount").over(whole) * 100).cast("double")
    return (
        parts.withColumn("weight", weight)
        .join(target, bucket, "left")
        .select(
            owner,
            bucket,
            "weight",
            (F.col("weight") - F.col("target_weight")).alias("drift"),
            F.when(F.col("weight") < F.col("min_weight"), "under")
            .when(F.col("weight") > F.col("max_weight"), "over")
            .otherwise("inside")
            .alias("state"),
        )
    )


def attribution_difference(df: DataFrame, first: Column, second: Column, value: Column) -> DataFrame:
    """The same total by two attributions, side by side; only owners that differ."""
    total = lambda owner, name: df.groupBy(owner.alias("owner")).agg(F.sum(value).alias(name))
    both = total(first, "by_first").join(total(second, "by_second"), "owner", "full_outer")
    zero = F.lit(0).cast("decimal(28,4)")
    return both.select(
        "owner",
        F.coalesce(F.col("by_first").cast("decimal(28,4)"), zero).alias("by_first"),
        F.coalesce(F.col("by_second").cast("decimal(28,4)"), zero).alias("by_second"),
    ).where("by_first <> by_second")


def near_threshold(df: DataFrame, value: str, ceiling: Column, share: float) -> DataFrame:
    """Rows below a ceiling but within a share of it."""
    return df.where((F.col(value) < ceiling) & (F.col(value) >= ceiling * (1 - share)))


def factor_product(actions: DataFrame, keys: Sequence[str], factor: Column) -> DataFrame:
    """Cumulative factor per instrument; equal factors are counted first, then multiplied."""
    counted = actions.groupBy(*keys, factor.alias("factor")).agg(F.count(F.lit(1)).alias("n"))
    product = F.exp(F.sum(F.ln("factor") * F.col("n")))
    return counted.groupBy(*keys).agg(product.alias("factor"), F.sum("n").alias("actions"))
