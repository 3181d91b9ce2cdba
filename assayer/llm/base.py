"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.session import cut_lineage, fresh_path


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with ``new`` at the end; an input column of the same name gives way to the new one."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def with_fields(df: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """``df`` with the fields ``names`` of the struct ``value``, computed once."""
    packed = df.withColumn("_fields", value)
    return with_columns(packed, {n: F.col(f"_fields.{n}") for n in names}).drop("_fields")


#: Folders written in the ``scratch`` blocks that are open now, the innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at its end what was written inside, but for what was to be kept.

    What leaves the block must therefore be read from kept tables only.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str, keep: bool = False, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later reads survive lost executors.

    Inside a ``scratch`` block the table goes at the block's end; with ``keep`` it goes with the block
    around it, if there is one. ``options`` are those of the writer.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    if _OPEN[: -1 if keep else None]:
        _OPEN[-2 if keep else -1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So many rows at most, each of a few fields, are sent to every executor.
FEW = 50_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``FEW`` rows; otherwise the join moves both sides.

    Counted where it is called, so ``df`` should be a written table.
    """
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def with_next(ids: DataFrame, key: str, into: str) -> DataFrame:
    """For distinct ``key`` values, the next larger one; the largest is followed by the smallest.

    Sorted with a range exchange; only the first key of every range meets in one task.
    """
    placed = cut_lineage(
        ids.orderBy(F.col(key).asc_nulls_first()).withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_place", 33))
    firsts = placed.groupBy("_range").agg(F.min_by(F.struct(key), "_place").alias("_first"))
    ranges = Window.orderBy("_range")
    everything = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(
        "_range",
        F.coalesce(F.lead("_first").over(ranges), F.first("_first").over(everything)).alias("_after"),
    )
    inside = Window.partitionBy("_range").orderBy("_place")
    following = F.coalesce(F.lead(F.struct(key)).over(inside), F.col("_after"))
    return (
        placed.join(after, "_range")
        .withColumn("_following", following)
        .withColumn(into, F.col(f"_following.{key}"))
        .drop("_place", "_range", "_after", "_following")
    )
