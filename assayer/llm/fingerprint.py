"""Threshold-scaled sketches of word shingles, as expressions and DataFrame operations only.

A sketch holds every shingle hash below a threshold. The threshold is a fixed fraction of the hash
range; a document of few shingles, for which that would keep next to nothing, gets the threshold
at which it keeps ``LEAST`` hashes (or all it has). Two sketches are compared below the smaller of
their thresholds, where both are complete; so they can be merged (union, smaller threshold) and
containment can be estimated between documents of very unequal lengths.

Null counts as the empty text: no shingles and an empty sketch. Fewer than ``WORDS`` words make one
shingle. A word ends at ASCII white space. Equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import with_next
from assayer.session import cut_lineage

#: Words in a shingle, kept fraction of the hash range, hashes kept at least.
WORDS, FRACTION, LEAST = 5, 1 / 32, 48
#: Hashes are 53-bit numbers, which a double holds exactly.
RANGE = 1 << 53
BLANK = " \t\n\u000b\f\r"


def words_of(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(BLANK)), r"[\x20\x09-\x0D]+")


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """Sorted distinct hashes of the shingles of ``words``, which has to be a plain column."""
    def hashed(i: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + k) for k in range(size)]), 11)

    whole = F.shiftrightunsigned(F.xxhash64(F.array_join(words, " ")), 11)
    return (
        F.when(F.size(words) >= size, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - size), hashed))))
        .when(F.element_at(words, 1) != "", F.array(whole))
        .otherwise(F.array().cast("array<bigint>"))
    )


def threshold(hashes: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The fixed fraction, or more where that is needed to keep ``least`` of the sorted hashes."""
    need = F.when(F.size(hashes) <= least, F.lit(RANGE)).otherwise(F.get(hashes, F.lit(least - 1)) + 1)
    return F.greatest(F.lit(int(RANGE * fraction)), need)


def below(hashes: Column, limit: Column) -> Column:
    return F.filter(hashes, lambda h: h < limit)


def sketched(df: DataFrame, text: Column, into: str) -> DataFrame:
    """Add the struct ``into``: ``limit`` and the sorted ``hashes`` below it."""
    return (
        df.withColumn("_words", words_of(text))
        .withColumn("_hashes", shingle_hashes(F.col("_words")))
        .withColumn("_limit", threshold(F.col("_hashes")))
        .withColumn(into, F.struct(F.col("_limit").alias("limit"), below(F.col("_hashes"), F.col("_limit")).alias("hashes")))
        .drop("_words", "_hashes", "_limit")
    )


def as_text(sketch: Column) -> Column:
    """``limit:hash,hash,...`` in hexadecimal digits."""
    return F.concat(F.hex(sketch["limit"]), F.lit(":"), F.array_join(F.transform(sketch["hashes"], F.hex), ","))


def compared(df: DataFrame, a: str, b: str, held: str, jaccard: str) -> DataFrame:
    """Add the estimated share of ``a`` that ``b`` holds, and their Jaccard similarity.

    Two empty sketches are alike (1), an empty one and another are not (0).
    """
    limit = F.least(F.col(f"{a}.limit"), F.col(f"{b}.limit"))
    out = (
        df.withColumn("_l", limit)
        .withColumn("_a", below(F.col(f"{a}.hashes"), F.col("_l")))
        .withColumn("_b", below(F.col(f"{b}.hashes"), F.col("_l")))
        .withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    )
    none = (F.size("_a") == 0) & (F.size("_b") == 0)
    either = F.size("_a") + F.size("_b") - F.col("_both")
    return (
        out.withColumn(held, F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(F.col("_both").cast("double"), F.size("_a").cast("double")), F.lit(0.0))))
        .withColumn(jaccard, F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(F.col("_both").cast("double"), either.cast("double")), F.lit(0.0))))
        .drop("_l", "_a", "_b", "_both")
    )


def keyed(df: DataFrame, key: Column, kind: str) -> DataFrame:
    """``df`` dealt by ``key``, which becomes ``k`` and ``k_null``: two columns that equal joins can use."""
    split = df.withColumn("k", F.coalesce(key, F.lit(0).cast(kind))).withColumn("k_null", key.isNull())
    return split.repartition("k", "k_null")


def with_next_document(rows: DataFrame, order: DataFrame, repeated: bool) -> DataFrame:
    """Add ``next_head``, the part of the next document's text that an edit needs, and ``next_sketch``.

    ``rows`` (k, k_null, text, sketch) is dealt by its key already and is read by both joins in the same
    columns, so that texts move once; heads and sketches move once more, to the document before.
    """
    asked = order.select(
        F.coalesce("next", F.lit(0).cast(order.schema["key"].dataType)).alias("k"), F.col("next").isNull().alias("k_null"),
        F.col("key").alias("_for"), "need", "next_th",
    )
    # written so that the hash does not become a join key, for which the texts would be dealt again
    right_text = F.xxhash64("text").bitwiseXOR(F.col("next_th")) == 0
    found = rows.join(asked, ["k", "k_null"]).where(right_text).select(
        F.coalesce("_for", F.lit(0).cast(order.schema["key"].dataType)).alias("k"), F.col("_for").isNull().alias("k_null"),
        F.expr("left(text, int(need))").alias("next_head"), F.col("sketch").alias("next_sketch"),
    )
    if repeated:  # equal rows would each bring an answer
        found = found.dropDuplicates(["k", "k_null"])
    return rows.join(found, ["k", "k_null"])


def followers(df: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """Per distinct ``key``: the ``next`` one, the hash ``next_th`` of its text and the code points ``need``ed
    of it; and whether any key repeats.

    Keys follow each other in ascending order (null first, the last is followed by the first). Where
    several rows have a key, the one whose text has the smallest hash stands for it.
    """
    ids = df.groupBy(F.col(key).alias("key")).agg(
        F.max(F.expr(f"length({text}) div 4")).alias("need"), F.min(F.xxhash64(text)).alias("th"), F.count(F.lit(1)).alias("rows")
    )
    order = cut_lineage(with_next(ids, "key", "next"))
    hashes = order.select(F.col("key").alias("_own"), F.col("th").alias("next_th"))
    order = order.join(hashes, F.col("next").eqNullSafe(F.col("_own"))).drop("_own")
    return order, (order.agg(F.max("rows")).first()[0] or 0) > 1


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last quarter of the code points replaced by the first as many (or all)
    of the next document. ``near_*`` is the share of the fingerprint that the other one holds,
    ``jaccard_*`` the symmetric likeness. One row per input row; other columns are left out.
    """
    own = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    order, repeated = followers(own, "key", "text")
    rows = keyed(sketched(own, F.col("text"), "sketch"), F.col("key"), kind).select("k", "k_null", "text", "sketch")
    both = with_next_document(rows, order, repeated).withColumn("n_chars", F.length("text").cast("long"))
    edit = F.expr("concat(left(text, int(n_chars - n_chars div 4)), left(next_head, int(n_chars div 4)))")
    both = both.withColumn("edited", edit).drop("text", "next_head")
    both = sketched(both, F.col("edited"), "edited_sketch")
    both = compared(both, "sketch", "edited_sketch", "near_edited", "jaccard_edited")
    both = compared(both, "sketch", "next_sketch", "near_next", "jaccard_next")
    return both.select(
        F.when(~F.col("k_null"), F.col("k")).alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next", "jaccard_edited", "jaccard_next",
    )
