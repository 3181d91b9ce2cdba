"""Repeated runs of lines: a suffix array over line ids by prefix doubling, DataFrame operations only.

The sequence is every document's lines that have a word; the end of a document matches nothing.
A run counts when it has at least ``WORDS`` words. Runs that have occurred before are deleted: a line
goes if it lies in a run of ``WORDS`` words or more that also stands at an earlier place (by document
key, then line). What remains of a maximal repeated run is thus its first copy.

* Level 0 ranks the lines that occur more than once; a line that occurs once ends every suffix that
  could match, so it is discarded (as are suffixes that have become unique at later levels).
* Level k + 1 ranks pairs (rank k here, rank k 2^k lines on). Ranks keep the order of the pairs, so
  the last level is the suffix array of what is repeated, cut at depth 2^k; rows of equal rank are
  an interval whose common prefix has 2^k lines.
* A run of m lines is named by its first and its last 2^k lines (2^k <= m < 2^(k + 1)), an interval of
  depth m. Any repeated run of ``WORDS`` words is a union of two kinds of windows: those that start at
  a line and end where ``WORDS`` is reached, and those that end at a line and start as late as they
  can. A window has at most ``WORDS`` lines, so log2(``WORDS``) levels are enough.

Null or empty texts have no lines and stay as they are. Rows of equal key and text are one document:
each gets the same result. Rows of equal key and different texts follow each other by the texts'
hashes. Lines without words are kept, unless all lines with words go, when nothing is left. Ordinary
repeated headers stay, being shorter than ``WORDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.base import scratch, with_columns, written

#: Words from which a repeated run counts.
WORDS = 50


BLANK = " \t\u000b\f\r"


def sequence(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with words: document (``d`` and ``th``, the hash of its text), place ``p`` among such
    lines, line number ``q``, number of words ``w`` and two hashes."""
    trimmed = F.transform(
        F.split(F.col(f"`{text}`"), "\n"), lambda x, i: F.struct(i.alias("q"), F.btrim(x, F.lit(BLANK)).alias("b"), x.alias("x"))
    )
    rows = docs.select(F.col(f"`{key}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("th"), trimmed.alias("lines"))
    rows = rows.select("d", "th", F.posexplode(F.filter("lines", lambda s: s["b"] != "")).alias("p", "s"))
    return rows.select(
        "d", "th", "p", "s.q", F.size(F.split("s.b", r"[\x20\x09-\x0D]+")).alias("w"),
        F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(1), "s.x").alias("h2"),
    )


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["d"].eqNullSafe(b["d"]) & (a["th"] == b["th"])


def ranked(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """Those of the values ``names`` that occur more than once, with a ``rank`` that keeps their order."""
    repeated = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return written(repeated.orderBy(*names).withColumn("rank", F.monotonically_increasing_id()), label)


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Level 0: the lines that occur more than once, one row per place, with their ranks."""
    found = lines.join(ranked(lines, ["h1", "h2"], "lines"), ["h1", "h2"])
    return written(found.select("d", "th", "p", "q", "w", "rank").dropDuplicates(["d", "th", "p"]), "level")


def doubled(level: DataFrame, step: int) -> DataFrame:
    """The next level: ranks of the pairs (rank here, rank ``step`` lines on) that occur more than once."""
    here = level.select("d", "th", "p", F.col("rank").alias("r1"))
    ahead = level.select("d", "th", (F.col("p") - step).alias("p"), F.col("rank").alias("r2"))
    pairs = here.join(ahead, same_document(here, ahead) & (here["p"] == ahead["p"])).select(here["*"], "r2")
    pairs = written(pairs, "pairs")
    return written(pairs.join(ranked(pairs, ["r1", "r2"], "ranks"), ["r1", "r2"]).select("d", "th", "p", "rank"), "level")


def windows(lines: DataFrame, words: int) -> DataFrame:
    """Shortest windows of ``words`` words inside the repeated lines: (d, th, a, m), ``m`` lines from ``a`` on.

    Windows stay within a stretch of repeated lines, as no other window can occur twice.
    """
    place = Window.partitionBy("d", "th").orderBy("p")
    inside = lines.withColumn("stretch", F.col("p") - F.row_number().over(place))
    within = Window.partitionBy("d", "th", "stretch").orderBy("p")

    def shortest(near: str) -> Column:
        """Number of leading entries that reach ``words``; null where all of them don't."""
        done = F.aggregate(
            near, F.struct(F.lit(0).alias("m"), F.lit(0).alias("sum")),
            lambda acc, w: F.when(acc["sum"] >= words, acc).otherwise(
                F.struct((acc["m"] + 1).alias("m"), (acc["sum"] + w).alias("sum"))
            ),
        )
        return F.when(done["sum"] >= words, done["m"])

    near = inside.select(
        "d", "th", "p",
        F.collect_list("w").over(within.rowsBetween(0, words - 1)).alias("ahead"),
        F.reverse(F.collect_list("w").over(within.rowsBetween(1 - words, 0))).alias("behind"),
    ).select("d", "th", "p", shortest("ahead").alias("m1"), shortest("behind").alias("m2"))
    both = F.array(
        F.struct(F.col("p").alias("a"), F.col("m1").alias("m")),
        F.struct((F.col("p") - F.col("m2") + 1).alias("a"), F.col("m2").alias("m")),
    )
    return near.select("d", "th", F.explode(both).alias("w")).select("d", "th", "w.a", "w.m").where("m is not null").distinct()


def named_windows(level: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Windows of 2^k to 2^(k + 1) - 1 lines with the ranks of their first and last 2^k lines."""
    mine = wanted.where((F.col("m") >= 1 << k) & (F.col("m") < 2 << k)).withColumn("b", F.expr(f"a + m - {1 << k}"))
    head = level.select("d", "th", "p", F.col("rank").alias("r1"))
    part = mine.join(head, same_document(mine, head) & (mine["a"] == head["p"])).select(mine["*"], "r1")
    tail = level.select("d", "th", "p", F.col("rank").alias("r2"))
    both = part.join(tail, same_document(part, tail) & (part["b"] == tail["p"])).select(part["*"], "r2")
    return both.select("d", "th", "a", "m", "r1", "r2")


def later_copies(lines: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Level 0, and (d, th, a, m) of the windows that also stand at an earlier place."""
    level = first = repeated_lines(lines)
    wanted = written(windows(first, words), "windows")
    longest = wanted.agg(F.max("m")).first()[0] or 0
    named, k = named_windows(level, wanted, 0), 0
    while 2 << k <= longest:
        level, k = doubled(level, 1 << k), k + 1
        named = named.unionByName(named_windows(level, wanted, k))
    named = written(named, "named")
    place = F.struct("d", "th", "a")
    firsts = named.groupBy("m", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts, "firsts")  # so that a window of very many copies can be split in the join
    return first, named.join(firsts, ["m", "r1", "r2"]).where(place != F.col("first")).select("d", "th", "a", "m")


def deletions(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per document with later copies: ``d``, ``th`` and the sorted line numbers ``gone``."""
    first, copies = later_copies(written(sequence(docs, key, text), "sequence"), words)
    gone = copies.select("d", "th", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("m") - 1)).alias("p")).distinct()
    placed = gone.join(first, same_document(gone, first) & (gone["p"] == first["p"])).select(gone["d"], gone["th"], "q")
    return placed.groupBy("d", "th").agg(F.array_sort(F.collect_list("q")).alias("gone"))


def without_lines(lines: Column, gone: Column) -> Column:
    """Text of ``lines`` without those numbered in the sorted ``gone``: the stretches between them, joined."""
    def stretch(i: Column) -> Column:
        after = F.coalesce(F.get(gone, i - 1), F.lit(-1))
        before = F.coalesce(F.get(gone, i), F.size(lines))
        return F.slice(lines, after + 2, before - after - 1)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), stretch)), "\n")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, into: str = "kept") -> DataFrame:
    """Add the deleted line numbers ``gone_lines`` (null for none) and ``into``, the text that is left."""
    with scratch(docs.sparkSession):
        gone = written(deletions(docs, key, text, words), "gone", keep=True)
    own = docs.withColumn("_th", F.xxhash64(F.col(f"`{text}`")))
    # merged whatever the size of ``gone``, which has no bound
    joined = own.join(gone.hint("merge"), own[key].eqNullSafe(gone["d"]) & (own["_th"] == gone["th"]), "left").select(
        own["*"], F.col("gone").alias("_gone")
    ).withColumn("_lines", F.split(F.col(f"`{text}`"), "\n"))
    left = F.when(F.col("_gone").isNull(), F.col(f"`{text}`")).otherwise(without_lines(F.col("_lines"), F.col("_gone")))
    return with_columns(joined, {"gone_lines": F.col("_gone"), into: left}).drop("_th", "_gone", "_lines")


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` with later copies deleted from the text; rows of which nothing is left go."""
    out = dedup(docs, key, text, words, "_kept").where("gone_lines is null or btrim(_kept, ' \\t\\n\\u000b\\f\\r') <> ''")
    return out.select(*[F.col("_kept").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
