"""Exact Jaccard join of word-shingle sets through a token-group matrix.

1. *Sets.* Documents of equal shingle sets are one node, named by a 64-bit hash of the set.
2. *Segments.* Sets of sizes a and b whose Jaccard similarity reaches t differ in at most
   (a + b)(1 - t)/(1 + t) shingles. Shingles are dealt over one segment more than that by their hash, so
   similar sets agree in a whole segment. Only nodes that share a segment with another go on. A frequent
   shingle, line or passage brings nothing together by itself: all of a segment has to agree. Segments
   are counted for the largest sizes of a class, so smaller sets have to agree in more of them. A segment without
   shingles counts as agreed; it is looked up only for a set with so many of them that nothing else might agree.
3. *Groups.* Every such node joins the group of the node it shares most segments with, of those that
   meet most others in a segment. Members are checked against that node first; those that link to it are
   connected from then on, whatever the size of the group.
4. *Token-group matrix.* A row per group, a column per slice of the hash range: the columns that
   the group's members use, or-ed together. For a query and a group with which it shares enough
   segments, but not yet its component, the query's columns that the group lacks are shingles that it lacks. If they
   are more than the threshold allows, no member can be similar and the group stays closed.
5. *Differences.* Query and members of an opened group are told apart by what each differs in from the group's
   first node. Similar ones that do not both link to that node have some of these differences in common, so they meet in
   the rarest of them only (``alike``), and are checked exactly.

Links thus found have the components of all links. Nothing is capped; no group is gathered in one
task. Sets that are near to each other but do not link are compared where they share differences that are rare in their group.

Texts without words have no set and link with nothing. A null key is a key of its own; a component takes
its smallest key that is not null. Rows of equal key and text are told apart nowhere and get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import scratch, written
from assayer.llm.components import components
from assayer.llm.words import WordHashes, hashed

#: Ratio of the largest to the smallest size in a class of sizes, columns of the matrix per shingle,
#: bits of the filters that keep texts and segments without a possible partner from being moved.
RATIO, COLUMNS, FILTER, SEGMENTS = 1.5, 4, 1 << 23, 1 << 26
LARGEST = 1 << 26
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOW, _32, _CLASS = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(63)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(31)) * _P
        return (x ^ x >> np.uint64(29)) * _Q


def shingles(flat: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; the whole sequence where it is shorter."""
    if not len(flat):
        return flat
    span = min(size, len(flat))
    with np.errstate(over="ignore"):
        h = np.full(len(flat) - span + 1, span, np.uint64)
        for i in range(span):
            h = (h ^ flat[i : len(flat) - span + 1 + i]) * _P
            h ^= h >> np.uint64(32)
    return np.unique(mix(h))


class Sizes:
    """Classes of set sizes and the number of segments of each, for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low, self.parts = num, den, [1], []
        while self.low[-1] <= LARGEST:
            low = self.low[-1]
            high = max(low, int(low * RATIO))
            parts = 2 * high * (den - num) // (den + num) + 1
            # so many more that the segments without shingles are not all that sets agree in
            self.parts.append(parts + round(4 * parts * math.exp(-high / parts)) if parts > 1 else 1)
            self.low.append(high + 1)

    def of(self, n: int) -> Iterator[int]:
        """The class of ``n``, and larger ones that hold sizes similar to ``n``; of one segment: equal sets only."""
        c = int(np.searchsorted(self.low, n, "right")) - 1
        while c < len(self.parts) and self.num * self.low[c] <= self.den * n:
            if self.parts[c] > 1:
                yield c
            c += 1

    def shared(self, c: int, n: int) -> int:
        """Segments of class ``c`` in which a set of ``n`` shingles agrees at least with any similar one."""
        total = n + min(self.low[c + 1] - 1, n * self.den // self.num)
        return self.parts[c] - total * (self.den - self.num) // (self.den + self.num)

    def segments(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """In each class that the set belongs to, a hash of every segment's shingles, and in how many of them similar sets agree at least.

        Of two similar sets, both or none can do without the segments that have no shingles: if all that they agree in were
        such segments, neither would have fewer of them than it agrees in with similar sets at least.
        """
        mixed = mix(tokens + _Q) if len(tokens) else tokens
        for c in self.of(len(tokens)):
            k, shared = self.parts[c], self.shared(c, len(tokens))
            part = ((tokens >> _32) * np.uint64(k) >> _32).astype(np.int64)
            # sums of halves stay exact in doubles
            low = np.bincount(part, weights=(mixed & _LOW).astype(np.float64), minlength=k).astype(np.uint64)
            high = np.bincount(part, weights=(mixed >> _32).astype(np.float64), minlength=k).astype(np.uint64)
            with np.errstate(over="ignore"):
                place = np.arange(k, dtype=np.uint64) + (np.uint64(c) << _32)
                # the last bits name the class
                sigs = mix(mix(low) + high * _P + mix(place + _P)) & ~_CLASS | np.uint64(c)
            held = np.bincount(part, minlength=k) > 0
            empty = k - int(held.sum())
            yield sigs[held] if empty < shared else sigs, max(1, shared - empty)

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        """The hashes of ``segments``, of all classes."""
        return np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in self.segments(tokens))])


def node_of(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.array([tokens.sum(dtype=np.uint64), len(tokens)], np.uint64)
        return int(mix(mix(total[:1]) + total[1:]).view(np.int64)[0])


def featured(docs: DataFrame, key: str, text: str, size: int, sizes: Sizes) -> DataFrame:
    """(d, th, n, node, sigs, least) of every row: key, hash of the text, set size, hash of the set, signatures.

    ``least`` holds for each signature in how many of those of its class similar sets agree at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            n, node, sigs, least = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            ends = [0]
            for t in batch.column(2).to_pylist():
                tokens = shingles(hashed([t], known)[0], size)
                n.append(len(tokens))
                node.append(node_of(tokens) if len(tokens) else None)
                own = list(sizes.segments(tokens))
                sigs += [s for s, _ in own]
                least += [np.full(len(s), x, np.int32) for s, x in own]
                ends.append(ends[-1] + sum(len(s) for s, _ in own))
            lists = (
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in (np.concatenate(sigs).view(np.int64), np.concatenate(least))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *lists],
                names=["d", "th", "n", "node", "sigs", "least"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"d {kind}, th long, n long, node long, sigs array<long>, least array<int>")


def marks(df: DataFrame, value: Column, size: int) -> np.ndarray:
    """A bit table of ``size`` bits in which the bits of all values are set; a bound on what reaches the driver."""
    bit = df.select(F.pmod(value, F.lit(size)).alias("b"))
    rows = bit.groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def is_marked(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    b = np.mod(values, len(table) * 64)
    return (table[b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def shared_segments(features: DataFrame) -> DataFrame:
    """(sig, node, n, least) of the segments in which different sets agree.

    All signatures are moved once, to find those of more than one set. Then only rows that pass a
    filter of ``SEGMENTS`` bits are moved, and the join drops those that pass by chance.
    """
    rows = features.where("n > 0").select("node", F.explode("sigs").alias("sig"))
    repeated = rows.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    repeated = written(repeated.select("sig"), "repeated")
    table = marks(repeated, F.shiftright("sig", 6), SEGMENTS)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sig = lists.flatten().to_numpy(zero_copy_only=False)
            kept = is_marked(sig >> 6, table)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[kept]
            least = batch.column(3).flatten().filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[kept]), *(batch.column(i).take(pa.array(row)) for i in (0, 1)), least], names=["sig", "node", "n", "least"]
            )

    some = features.where("n > 0").select("node", "n", "sigs", "least").mapInArrow(passing, "sig long, node long, n long, least int")
    return written(some.join(repeated, "sig").distinct(), "segments")


def grouped(segments: DataFrame) -> DataFrame:
    """(node, n, g): the group of every node. The centre of a segment is its node that meets most others in all of its segments."""
    met = segments.groupBy("sig").agg(F.count(F.lit(1)).alias("m"))
    common = segments.join(met, "sig").groupBy("node").agg(F.sum("m").alias("met"))
    first = F.max_by("node", F.struct("met", (-F.col("node")).alias("_")))
    centres = written(segments.join(common, "node").groupBy("sig").agg(first.alias("g")), "centres")
    near = segments.join(centres, "sig").groupBy("node", "n", "g").agg(F.count(F.lit(1)).alias("c"))
    best = F.max_by("g", F.struct("c", (-F.col("g")).alias("_")))
    return written(near.groupBy("node", "n").agg(best.alias("g")), "groups")


def texts_of(docs: DataFrame, features: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(node, t): a text of every node.

    The rows wanted are marked in a filter of ``FILTER`` bits, whatever their number; only rows that
    pass it are moved, and the join drops those that pass by chance.
    """
    one = features.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("th", "d")).alias("one"))
    one = written(one.select("node", "one.th", "one.d"), "wanted")
    table = marks(one, F.col("th"), FILTER)

    @F.pandas_udf("boolean")
    def marked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for th in parts:
            yield pd.Series(is_marked(th.to_numpy(), table))

    th = F.xxhash64(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").alias("d"), th.alias("th"), F.col(f"`{text}`").alias("t")).where(marked(th))
    found = rows.join(one.hint("merge"), rows["d"].eqNullSafe(one["d"]) & (rows["th"] == one["th"])).select("node", "t")
    return written(found.dropDuplicates(["node"]), "texts")


def checked(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = (shingles(hashed([t], known)[0], size) for t in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                kept.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(kept, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"]
            )

    one = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    met = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "ta", "tb")
    return written(met.mapInArrow(run, "a long, b long"), "links")


def differences(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, g, n, x, short, long, near, parts) of the ``pairs`` (node, g).

    ``parts`` are the ``x`` shingles that only one of the sets of ``node`` and ``g`` holds, ``near`` tells whether the sets are
    similar. ``short`` and ``long``: so many of the parts, in any order, hold one that a similar set has in common (see
    ``alike``), if that differs from ``g`` in at least, or at most, ``x`` shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows, parts = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = (shingles(hashed([t], known)[0], size) for t in (x, y))
                own = np.setxor1d(p, q, assume_unique=True)
                n, m, x, both = len(p), len(q), len(own), num + den
                near = both * x <= (den - num) * (n + m)
                least = (both * x + (den - num) * (m - n)) // (2 * both) if near else num * x // both
                most = n * (den - num) // num
                rows.append((n, x, min(x - least, most // 2 + 1), min(x, most + 1), near))
                parts.append(own.view(np.int64))
            if rows:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32()), pa.array(np.concatenate(parts), pa.int64()))
                kinds = [pa.int64()] * 4 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), lists],
                    names=["node", "g", "n", "x", "short", "long", "near", "parts"],
                )

    one = texts.select("node", F.col("t").alias("ta"))
    two = texts.select(F.col("node").alias("g"), F.col("t").alias("tb"))
    met = pairs.select("node", "g").join(two, "g").join(one, "node").select("node", "g", "ta", "tb")
    kinds = "node long, g long, n long, x long, short long, long long, near boolean, parts array<long>"
    return written(met.mapInArrow(run, kinds), "differences")


def alike(asked: DataFrame, groups: DataFrame, parts: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links of the (node, g) ``asked`` to the centres ``g``, and pairs (a, b) of them and members of ``g`` that may be similar.

    Two sets a and b differ in what differs between their differences from the centre. If not both are similar to the centre, similar sets
    have some of these differences in common, and of the set with fewer of them about half. With the rarest of the group first,
    ``short`` of the one's and ``long`` of the other's hold a common one. So copies of a text with changes of their own do not meet,
    however many they are.
    """
    members = groups.select("node", "g").join(asked.select("g").distinct(), "g").where("node <> g")
    both = asked.select("node", "g", F.lit(True).alias("asks"), F.lit(False).alias("member"))
    both = both.unionByName(members.select("node", "g", F.lit(False).alias("asks"), F.lit(True).alias("member")))
    both = written(both.where("node <> g").groupBy("node", "g").agg(F.max("asks").alias("asks"), F.max("member").alias("member")), "compared")
    found = differences(both, texts, size, num, den)

    each = found.select("node", "g", F.explode("parts").alias("e"))
    often = each.groupBy("g", "e").agg(F.count(F.lit(1)).alias("f"))
    # a difference of one node alone is as rare as can be and meets nothing, so only its number counts
    some = F.collect_list(F.when(F.col("f") > 1, F.struct("f", "e")))
    held = each.join(often, ["g", "e"]).groupBy("node", "g").agg(F.sort_array(some).alias("held"))
    held = found.drop("parts").join(held, ["node", "g"]).join(both, ["node", "g"]).join(parts, "node")
    alone = F.col("x") - F.size("held")
    held = held.withColumn("first", F.slice("held", 1, F.greatest(F.lit(0), F.col("long") - alone).cast("int"))).withColumn("alone", alone)
    rows = held.select("g", "node", "n", "x", "part", "asks", "member", "short", "alone", F.posexplode("first").alias("at", "e"))
    rows = written(rows.withColumn("e", F.col("e.e")).withColumn("brief", F.col("alone") + F.col("at") < F.col("short")).drop("alone", "at", "short"), "rare")

    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "x", "part", "asks", "member")]
    left = rows.where("brief").select("g", "e", *side("a"))
    right = rows.select("g", "e", *side("b"))
    fewer = F.struct("x_a", "node_a") < F.struct(F.col("x_b").alias("x_a"), F.col("node_b").alias("node_a"))
    close = (F.col("x_b") - F.col("x_a")) * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    sized = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    asking = (F.col("asks_a") & F.col("member_b")) | (F.col("asks_b") & F.col("member_a"))
    pairs = left.join(right, ["g", "e"]).where(fewer & close & sized & asking & (F.col("part_a") != F.col("part_b")))
    pairs = pairs.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()
    return found.where("near").select(F.col("node").alias("a"), F.col("g").alias("b")), pairs


def columns_of(texts: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """(node, g, w, bits): the matrix columns that each node uses, 64 to a row, at the width of group ``g``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = []
            for node, g, wide, t in zip(*(c.to_pylist() for c in batch.columns)):
                bit = shingles(hashed([t], known)[0], size) >> np.uint64(64 - wide)
                place = bit >> np.uint64(6)
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                word = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
                out.append((np.full(len(first), node), np.full(len(first), g), place[first].astype(np.int64), word.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["node", "g", "w", "bits"])

    rows = groups.join(texts, "node").select("node", "g", "wide", "t")
    return rows.mapInArrow(run, "node long, g long, w long, bits long")


def opened(asked: DataFrame, groups: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of the (node, n, g) ``asked`` whose bound on the overlap allows a similar member."""
    # the width follows the group's largest set
    wide = groups.groupBy("g").agg(F.ceil(F.log2(F.max("n") * COLUMNS)).cast("int").alias("wide"))
    wide = wide.withColumn("wide", F.greatest(F.lit(6), F.least(F.lit(40), "wide")))
    needed = asked.select("g").distinct()
    matrix = columns_of(texts, groups.select("node", "g").join(needed, "g").join(wide, "g"), size)
    matrix = matrix.groupBy("g", "w").agg(F.bit_or("bits").alias("union"))
    query = columns_of(texts, asked.select("node", "g").join(wide, "g"), size)
    lacking = F.sum(F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("union", F.lit(0).cast("long"))))))
    missing = query.join(matrix, ["g", "w"], "left").groupBy("node", "g").agg(lacking.alias("lacking"))
    allowed = F.col("n") - F.ceil(F.col("n") * num / den).cast("long")
    return asked.join(missing, ["node", "g"]).where(F.col("lacking") <= allowed).select("node", "g")


def links(docs: DataFrame, features: DataFrame, key: str, text: str, size: int, sizes: Sizes) -> DataFrame:
    """Pairs (a, b) of nodes that link, enough of them to connect all that is connected."""
    num, den, of_class = sizes.num, sizes.den, F.expr("int(sig & 63)").alias("c")
    segments = shared_segments(features)
    groups = grouped(segments)
    texts = texts_of(docs, features, groups, key, text)
    stars = checked(groups.where("node <> g").select(F.col("node").alias("a"), F.col("g").alias("b")), texts, size, num, den)

    placed = segments.join(groups.select("node", "g"), "node").join(components(stars), "node", "left")
    placed = placed.join(stars.select(F.col("a").alias("node"), F.lit(True).alias("near")), "node", "left")
    near = F.coalesce("near", F.col("node") == F.col("g")).alias("near")
    placed = written(placed.select("sig", "node", "n", "least", "g", near, F.coalesce("label", "node").alias("part")), "placed")
    met = placed.groupBy("sig", F.col("g").alias("h")).agg(*[
        of(F.when(F.col("near") == side, F.col("part"))).alias(f"{name}_{side}".lower())
        for side in (True, False) for name, of in (("low", F.min), ("high", F.max))
    ])
    # of two nodes one asks: the one that is not similar to its centre, else the one of the smaller group
    others = lambda side: F.coalesce((F.col("part") != F.col(f"low_{side}")) | (F.col("part") != F.col(f"high_{side}")), F.lit(False))
    asks = F.when(F.col("near"), (F.col("g") < F.col("h")) & others("true")).otherwise(others("true") | (F.col("g") <= F.col("h")) & others("false"))
    asked = placed.join(met, "sig").where(asks).select("node", "n", "least", F.col("h").alias("g"), of_class)
    asked = asked.groupBy("node", "n", "least", "g", "c").agg(F.count(F.lit(1)).alias("shared"))
    asked = asked.where("shared >= least").select("node", "n", "g").distinct()
    open_ = written(opened(written(asked, "asked"), groups, texts, size, num, den), "opened")

    parts = placed.select("node", "part").distinct()
    near, pairs = alike(open_, groups, parts, texts, size, num, den)
    return stars.union(near).union(checked(pairs, texts, size, num, den))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``key``, ``_th`` (hash of the text), ``n_shingles`` and ``component_id`` of every row."""
    with scratch(docs.sparkSession):
        return written(_joined(docs, key, text, size, Sizes(num, den)), "joined", keep=True)


def _joined(docs: DataFrame, key: str, text: str, size: int, sizes: Sizes) -> DataFrame:
    features = written(featured(docs, key, text, size, sizes), "features")
    labels = components(links(docs, features, key, text, size, sizes))
    leads = features.where("n > 0").groupBy("node").agg(F.min("d").alias("lead"))
    leads = written(leads.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "leads")
    least = leads.groupBy("label").agg(F.min("lead").alias("component_id"))
    by_node = leads.join(least, "label").select("node", "component_id")
    return features.join(by_node, "node", "left").select(
        F.col("d").alias(key), F.col("th").alias("_th"), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "d").alias("component_id"),
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their component, one row each."""
    with scratch(docs.sparkSession):
        kept = joined(docs, key, text, size, num, den).where(F.col(key).eqNullSafe(F.col("component_id")))
        kept = written(kept.select(F.col(key).alias("_k"), "_th").distinct(), "kept", keep=True)
    own = docs.withColumn("_th", F.xxhash64(F.col(f"`{text}`")))
    found = own.join(kept.hint("merge"), own[key].eqNullSafe(kept["_k"]) & (own["_th"] == kept["_th"]), "left_semi")
    if docs.count() > docs.select(key).distinct().count():  # rows of equal key: the first text stays
        least = found.groupBy(key).agg(F.min("_th").alias("_least"))
        keep = (F.col("_th") == F.col("_least")) | (F.length(text) == 0) | F.col(text).isNull()
        found = found.alias("f").join(least.withColumnRenamed(key, "_o"), F.col(key).eqNullSafe(F.col("_o"))).where(keep)
        found = found.dropDuplicates([key, "_th"])
    return found.select(*docs.columns)
