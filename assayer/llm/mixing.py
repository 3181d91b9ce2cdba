"""Mixing sources to target weights: capped water-filling and seeded repetitions.

A mix has a size in words, which the sources share by weight. A source that would be repeated more than
``epochs`` times is clamped at that many times its own size, and what it cannot take is dealt to the
others in proportion to their weights, until no source is above its clamp. Sources are clamped in the
order of size per weight, whichever round they fall in; so running sums of that order give the clamped
ones and the common level of the others without a round per clamp. Sums are exact integers.

A target of 2.4 times a source's size means two whole copies of each of its documents and 0.4 copies
more: in the order of a seeded hash the documents are taken once more, until the words of the target
are full; the last of them is taken in part, from its beginning. A source misses its target by less than a word,
whatever the sizes of its documents.

Weights go round over the sources, which are ordered by their UTF-8 bytes; the source null is one of its own
and comes last. A text that is null or has no words counts no words and takes none. Sources without words have target 0. Rows
that share key and size are alike, so it does not matter which of them is taken. An empty table gives no
rows. Columns of the documents that clash with the new ones are not carried along.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import scratch, small, written
from assayer.operators.ordering import numbered, running_sum

#: Characters that are no white space make words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, EPOCHS, SEED = (1, 2, 3), 3, 20240

_WIDE = "decimal(38,0)"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("-"))), 256)


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, total: int | None = None
) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight``, ``target``, its whole words ``full`` and whether it is ``clamped``.

    ``total``: words of the mix, by default as many as the sources have.
    """
    every = F.array(*[F.lit(int(w)) for w in weights])
    turn = ((F.col("place") - 1) % len(weights)).cast("int")
    placed = numbered(sizes, [], [F.col("source").asc_nulls_last()], "place").withColumn("weight", F.get(every, turn).cast("long"))
    ratio = F.col("source_size").cast(_WIDE) * (F.lit(math.lcm(*weights)) / F.col("weight")).cast("long")
    # sums over the sources in the order in which they are clamped
    summed = running_sum(
        placed.withColumn("ratio", ratio),
        [],
        ["ratio", "place"],
        {"upto": F.col("source_size").cast(_WIDE), "weights": F.col("weight").cast(_WIDE)},
        total=True,
    )
    mixed = F.col("upto_total") if total is None else F.lit(total).cast(_WIDE)
    left = mixed - epochs * (F.col("upto") - F.col("source_size"))  # what sources clamped before leave
    sharers = F.col("weights_total") - F.col("weights") + F.col("weight")
    clamped = epochs * F.col("source_size") * sharers <= left * F.col("weight")
    marked = written(summed.select("source", "source_size", "weight", clamped.alias("clamped"), mixed.alias("mixed")), "mix-sources")
    sums = marked.agg(
        F.sum(F.when(F.col("clamped"), F.col("source_size"))).alias("clamped"),
        F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("open"),
        F.max("mixed").alias("mixed"),
    ).first()
    rest, open_ = int(sums.mixed or 0) - epochs * int(sums.clamped or 0), int(sums.open or 1)
    most = F.expr(f"{epochs} * source_size")
    share = (F.lit(rest).cast(_WIDE) * F.col("weight")).cast("double") / F.lit(float(open_))
    whole = F.expr(f"cast({rest} as {_WIDE}) * weight div {open_}")
    return marked.select(
        "source", "source_size", "weight", "clamped",
        F.when(F.col("clamped"), most.cast("double")).otherwise(share).alias("target"),
        F.when(F.col("clamped"), most).otherwise(whole).cast("long").alias("full"),
    )


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, total: int | None = None, seed: int = SEED,
) -> DataFrame:
    """One row per document: ``key``, ``source``, ``size``, ``source_size``, ``target``, whole ``copies`` and
    the words of one more copy (``part``), and ``taken``, the words of both."""
    with scratch(docs.sparkSession):
        slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"))
        slim = written(slim, "mix-sizes")
        sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
        aims = targets(sizes, weights, epochs, total).withColumn(
            "copies", F.when(F.col("source_size") > 0, F.expr("full div source_size")).otherwise(0)
        )
        aims = written(aims, "mix-targets")
        aimed = slim.alias("d").join(small(aims).alias("a"), F.col("d.source").eqNullSafe(F.col("a.source"))).select(
            "d.key", "d.source", "d.size", "a.source_size", "a.target", "a.full", "a.copies"
        )
        return written(taken(aimed, seed), "mix", keep=True).select(
            F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", "part", "taken"
        )


def taken(aimed: DataFrame, seed: int) -> DataFrame:
    """``aimed`` with ``part`` and ``taken``: documents fill what whole copies leave of ``full``, in seeded order."""
    order = ["_draw", "key", "size"]
    summed = running_sum(aimed.withColumn("_draw", draw(F.col("key"), seed)), ["source"], order, {"upto": F.col("size")}).drop("_draw")
    quota = F.col("full") - F.col("copies") * F.col("source_size")
    part = F.greatest(F.least(quota - (F.col("upto") - F.col("size")), F.col("size")), F.lit(0)).cast("long")
    return summed.withColumn("part", part).withColumn("taken", F.col("copies") * F.col("size") + part)
