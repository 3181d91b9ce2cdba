"""Importance resampling of documents towards a target: hashed n-gram models and Gumbel top-k.

Words and word pairs are hashed into ``BUCKETS``; a smoothed multinomial over the buckets is fitted
to the target and one to all documents. A document's log weight is the sum of the log ratios of its
n-grams. Adding Gumbel noise to the log weights and keeping the k largest draws k documents without
replacement, in proportion to their weights. The noise is a hash of the key and the seed, so a
repeated run draws the same documents.

The model of the raw text counts every document. The target's is fitted on at most ``TARGET``
labelled documents. Null or empty texts have weight 0. Rows of equal key get equal noise; ties in
the drawn order fall to the smaller key. Without target documents every weight is 0, so that the
draw is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import with_columns
from assayer.llm.words import WordHashes, chunks, hashed
from assayer.operators.ordering import numbered

#: Hash buckets (a power of two), labelled documents that the target model uses at most, counts
#: added to every bucket.
BUCKETS, TARGET, SMOOTH = 1 << 14, 20_000, 1.0
_SHIFT = np.uint64(64 - 14)
_MIX, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def ngrams(texts: list[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text that each belongs to."""
    flat, ends = hashed(texts, known)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    with np.errstate(over="ignore"):
        single = (flat * _MIX) >> _SHIFT
        pair = ((flat[:-1] * _PAIR + flat[1:]) * _MIX) >> _SHIFT
    inside = owner[:-1] == owner[1:]
    return (
        np.concatenate([single, pair[inside]]).astype(np.int64),
        np.concatenate([owner, owner[:-1][inside]]),
    )


def counts(df: DataFrame, text: str) -> np.ndarray:
    """Occurrences of every bucket over all rows; each task sends at most one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = WordHashes(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                total += np.bincount(ngrams(texts[a:b], known)[0], minlength=BUCKETS)
        (used,) = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = df.select(F.col(f"`{text}`")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(BUCKETS)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.any():
        return np.zeros(BUCKETS)
    t, r = target + SMOOTH, raw + SMOOTH
    return np.log(t / t.sum()) - np.log(r / r.sum())


def bounded_keys(labelled: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct keys, the first in hash order: the same at every run."""
    return labelled.select(key).distinct().orderBy(F.xxhash64(key), key).limit(limit)


def log_weights(df: DataFrame, target: DataFrame, text: str = "text", into: str = "log_weight") -> DataFrame:
    """Add the log weight of every text; ``target`` holds texts of the wanted kind."""
    ratio = log_ratios(counts(target, text), counts(df, text))

    @F.pandas_udf("double")
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordHashes()
        for part in parts:
            texts = part.tolist()
            out = np.zeros(len(texts))
            for a, b in chunks(texts):
                bucket, owner = ngrams(texts[a:b], known)
                out[a:b] = np.bincount(owner, weights=ratio[bucket], minlength=b - a)
            yield pd.Series(out)

    return with_columns(df, {into: weigh(F.col(f"`{text}`"))})


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from the upper 52 bits of a hash."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def drawn(weighted: DataFrame, key: str, share: float, weight: str = "log_weight", seed: int = 7) -> DataFrame:
    """The ``share`` of the rows that Gumbel top-k draws, with ``gumbel_key`` and ``draw`` (1 is first)."""
    keyed = weighted.withColumn("gumbel_key", F.col(weight) + gumbel(F.col(f"`{key}`"), seed))
    placed = numbered(keyed, [], [F.col("gumbel_key").desc(), F.col(f"`{key}`").asc_nulls_last()], "draw")
    rows = weighted.count()
    return placed.where(F.col("draw") <= round(rows * share))


def target_share(labels: DataFrame, wanted: str) -> float:
    """Share of the labelled rows that are of the wanted kind; everything without labels."""
    row = labels.where(F.col(wanted).isNotNull()).agg(F.avg((F.col(wanted) == 1).cast("double"))).first()
    return 1.0 if row[0] is None else float(row[0])


def resample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", wanted: str = "quality",
    share: float | None = None, limit: int = TARGET, seed: int = 7,
) -> DataFrame:
    """Draw documents towards those labelled 1 in ``wanted``.

    Returns ``key``, ``log_weight``, ``gumbel_key`` and ``draw``. Without ``share`` as large a part
    is drawn as the wanted kind has among the labels.
    """
    share = target_share(labels, wanted) if share is None else share
    keys = F.broadcast(bounded_keys(labels.where(F.col(wanted) == 1), key, limit))  # at most ``limit`` numbers
    slim = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    target = slim.join(keys, key, "left_semi")
    weighted = log_weights(slim, target, text).drop(text)
    return drawn(weighted, key, share, seed=seed)
