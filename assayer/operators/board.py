"""Ranked boards from nested entry rows (system, protocol, results)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.ordering import numbered, running_sum

BANDS = ("reference", "measured", "legacy")  # fixed values, in board order


def metric_mean(metric: str, missing: float | None = None) -> Column:
    mean = F.col(f"results.{metric}.mean")
    return mean if missing is None else F.coalesce(mean, F.lit(missing))


def all_pass() -> Column:
    """Ranking metric; an entry without it sorts last."""
    return metric_mean("pass_all", -1.0)


def current_snapshot(entries: DataFrame) -> DataFrame:
    return entries.agg(F.max("protocol.data_snapshot_id").alias("snapshot"))


def dollars_per_correct(cost: Column, rate: Column) -> Column:
    return F.when(rate > 0, cost / rate)


def banded(entries: DataFrame) -> DataFrame:
    """Flat board columns with the band; the newest snapshot is a one-value subquery."""
    newest = current_snapshot(entries).scalar()
    band = (
        F.when(F.col("system.kind") == "reference", "reference")
        .when(F.col("protocol.data_snapshot_id") == newest, "measured")
        .otherwise("legacy")
    )
    order = F.when(F.col("band") == "reference", 0).when(F.col("band") == "measured", 1).otherwise(2)
    return entries.select(
        "entry_id",
        F.col("system.name").alias("system"),
        F.col("system.arm").alias("arm"),
        band.alias("band"),
        all_pass().alias("rate"),
        metric_mean("execution_accuracy", 0.0).alias("execution_accuracy"),
        metric_mean("cost_usd_per_task").alias("cost"),
        metric_mean("median_latency_s").alias("latency"),
        F.col("protocol.runs").alias("runs"),
        F.col("protocol.attempted").alias("attempted"),
        F.col("protocol.denominator").alias("denominator"),
    ).withColumn("band_order", order)


def board(entries: DataFrame) -> DataFrame:
    """Position of every row, rank of the measured ones, leader flag and relative width."""
    flat = banded(entries)
    measured = F.col("band") == "measured"
    best = F.coalesce(flat.where(measured).agg(F.max("rate")).scalar(), F.lit(0.0))
    widest = F.greatest(F.coalesce(flat.agg(F.max("rate")).scalar(), F.lit(0.01)), F.lit(0.01))
    placed = running_sum(
        flat,
        [],
        ["band_order", F.col("rate").desc(), "entry_id"],
        {"position": F.lit(1), "rank": measured.cast("int")},
    )
    short = F.coalesce(F.col("attempted") < F.col("denominator"), F.lit(False))
    return placed.select(
        F.col("position").cast("long").alias("position"),
        F.when(measured, F.col("rank").cast("long")).alias("rank"),
        "entry_id",
        "arm",
        "band",
        "rate",
        (measured & (F.abs(F.col("rate") - best) < 1e-9)).alias("leader"),
        (100 * F.greatest(F.col("rate"), F.lit(0.0)) / widest).alias("width"),
        F.when(short, F.col("attempted")).otherwise(F.col("denominator")).alias("attempted"),
        "denominator",
        short.alias("short"),
        dollars_per_correct(F.col("cost"), F.col("rate")).alias("dollars_per_correct"),
    )


def undeclared_arms(entries: DataFrame) -> DataFrame:
    """Entries that may not be ranked: the arm is declared, never guessed."""
    arm = F.col("system.arm")
    return entries.where(~F.coalesce(arm.isin("controlled", "commercial"), F.lit(False)))


def rank_by_arm(entries: DataFrame) -> DataFrame:
    measured = banded(entries).where("band = 'measured'").select("entry_id", "arm", "rate")
    return numbered(measured, ["arm"], [F.col("rate").desc(), "entry_id"], into="rank")


def tier_pivot(entries: DataFrame, tiers: list[str]) -> DataFrame:
    """Systems by tiers; a tier without a value stays empty."""
    cells = entries.select("entry_id", F.explode("results.by_tier").alias("tier", "rate"))
    wide = cells.groupBy("entry_id").pivot("tier", tiers).agg(F.first("rate"))
    return wide.select("entry_id", *[F.col(f"`{t}`").alias(f"T{t}") for t in tiers])


def session_pivot(entries: DataFrame, sessions: list[str]) -> DataFrame:
    """Systems by sessions: turns passed of turns total, with a mark when every turn passed."""
    cells = entries.select("entry_id", F.explode("results.by_session").alias("session", "s"))
    text = F.concat(
        F.col("s.turns_passed").cast("string"),
        F.lit("/"),
        F.col("s.turns_total").cast("string"),
        F.when(F.col("s.session_passed"), " *").otherwise(""),
    )
    wide = (
        cells.select("entry_id", "session", text.alias("cell"))
        .groupBy("entry_id")
        .pivot("session", sessions)
        .agg(F.first("cell"))
    )
    return wide.select("entry_id", *sessions)


def session_order(entries: DataFrame) -> DataFrame:
    """Session labels by length, then text; labels are counted before they are moved."""
    names = entries.select(F.explode(F.map_keys("results.by_session")).alias("session")).distinct()
    keyed = names.withColumn("width", F.length("session"))
    return numbered(keyed, [], ["width", "session"], into="place").select("session", "place")


def efficiency_rows(entries: DataFrame) -> DataFrame:
    """Measured rows with a positive rate and a cost or a latency, in rate order."""
    rows = banded(entries).where(
        "band = 'measured' and rate > 0 and (cost is not null or latency is not null)"
    )
    return numbered(
        rows.select("entry_id", "rate", "cost", "latency"),
        [],
        [F.col("rate").desc(), "entry_id"],
        into="place",
    )


def header(entries: DataFrame) -> DataFrame:
    """Facts shown above the board; a shared attempted count is shown only when there is one."""
    flat = banded(entries)
    real = F.when(F.col("attempted") > 0, F.col("attempted"))
    single = F.min(real) == F.max(real)
    measured_runs = F.max(F.when(F.col("band") == "measured", F.col("runs")))
    return flat.agg(
        F.max("denominator").alias("denominator"),
        F.when(single, F.min(real)).otherwise(F.max("denominator")).alias("attempted"),
        F.coalesce(measured_runs, F.lit(1)).alias("runs"),
        F.min(F.when(F.col("band") == "reference", F.col("entry_id"))).alias("control_entry"),
        F.count_if(F.col("band") == "measured").alias("ranked"),
        F.count_if(F.col("band") == "legacy").alias("legacy"),
    )
