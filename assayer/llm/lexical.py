"""Ranked lexical search over bit-sliced Bloom signatures.

Each document has a Bloom signature of its terms. A term that occurs more than once is entered again for every count of
``COUNTS`` that it reaches, so a signature never claims fewer occurrences than there are. Signatures of documents
with about as many entries have the same number of bits and are stored in blocks, sliced: a row of a block's bitmap is one bit
of all its documents. One pass over the texts writes, partition by partition, the blocks with their texts, the number of
documents that hold each term, and the numbers of documents and terms; no text is shuffled.

A search takes its items in blocks of bounded size (``ITEMS``, ``TERMS``):

1. The slices of a term are intersected; the counts that remain possible and the lengths of the documents give the most that the
   term can add to each score. The weighted sums over an item's terms are upper bounds. The ``k``
   documents of highest bound of each item are scored exactly, from their texts.
2. The bounds are made again. A document is excluded only if its bound is below the k-th of these exact scores, or equal to
   it with a larger key. All others are scored exactly, from the texts beside the bitmap, and ranked; so the result is that of
   a full scan.

Terms are the maximal runs of characters other than ASCII ones that are no letters or digits, with A-Z in lower case. A
document without terms is not counted and never found; a null text has none, and neither has a null item. An
item that occurs twice is searched twice. Documents that share a key are documents of their own; a null key comes first among
equal scores. Without documents or items there are no rows. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from assayer.llm.base import scratch, written

#: Bits per entry and slices per entry of a signature; bits of a block's bitmap.
BITS, SLICES, BLOCK = 20, 6, 1 << 21
#: Documents of a block at most.
WIDTH = 512
#: Counts of a term that have an entry of their own.
COUNTS = [1, *(n for k in range(1, 40) for n in (1 << k, 3 << k - 1))]
_COUNTS = np.array(COUNTS)
#: Items and distinct terms that are searched together; terms whose bounds are made together.
ITEMS, TERMS, TOGETHER = 2048, 1 << 17, 2048
#: Terms whose counts a task holds before it writes them.
HELD = 100_000
#: Groups into which the rows of an item are dealt before they are ranked.
DEALT = 64
#: A row of the index holds hundreds of KB, so pages and row groups end by size, not after the usual 100 rows.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "2", "parquet.block.size.row.check.min": "4"}

_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).lower().split()


def positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The ``SLICES`` bits of each term for the count ``COUNTS[level]``."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(bits) for i in range(SLICES)]).astype(np.int64)


def sliced(bits: int, docs: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """The bitmap of a block: ``bits`` rows, a column per document, eight columns a byte. ``docs``: hashes and counts of terms."""
    width = -(-len(docs) // 8) * 8
    table = np.zeros(bits * width, np.uint8)
    hashes = np.concatenate([h for h, _ in docs])
    counts = np.concatenate([c for _, c in docs])
    column = np.repeat(np.arange(len(docs)), [len(h) for h, _ in docs])
    for level, least in enumerate(COUNTS):
        reached = counts >= least
        if not reached.any():
            break
        hashes, counts, column = hashes[reached], counts[reached], column[reached]
        for row in positions(hashes, level, bits):
            table[row * width + column] = 1
    return np.packbits(table.reshape(bits, width), axis=1).tobytes()


def signature_bits(counts: np.ndarray) -> int:
    """Bits for a document's entries, rounded up to three binary digits."""
    need = BITS * int(_COUNTS.searchsorted(counts, side="right").sum())
    step = 1 << max(need.bit_length() - 3, 3)
    return -(-need // step) * step


class Writer:
    """What a task collects: pending documents by signature size, document counts of terms, and totals."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.pending: dict[int, list] = defaultdict(list)
        self.df: Counter[bytes] = Counter()
        self.documents = self.terms = 0

    def row(self, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([values.get(f.name)], f.type) for f in self.schema], schema=self.schema
        )

    def block(self, bits: int) -> pa.RecordBatch:
        docs = self.pending.pop(bits)
        return self.row(bits=bits, keys=[d[0] for d in docs], sizes=[d[1] for d in docs], texts=[d[2] for d in docs],
                        slices=sliced(bits, [d[3] for d in docs]))

    def dictionary(self) -> pa.RecordBatch:
        out = self.row(words=list(self.df.keys()), df=list(self.df.values()))
        self.df.clear()
        return out

    def add(self, key, text: str | None) -> Iterator[pa.RecordBatch]:
        found = Counter(terms(text))
        if not found:
            return
        counts = np.fromiter(found.values(), np.int64, len(found))
        hashes = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
        size, bits = int(counts.sum()), signature_bits(counts)
        self.documents, self.terms = self.documents + 1, self.terms + size
        self.df.update(found.keys())
        if len(self.df) >= HELD:
            yield self.dictionary()
        self.pending[bits].append((key, size, text, (hashes, counts.astype(np.int32))))
        if len(self.pending[bits]) >= min(max(BLOCK // bits // 8 * 8, 1), WIDTH):
            yield self.block(bits)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for bits in list(self.pending):
            yield self.block(bits)
        if self.documents:
            yield self.dictionary()
            yield self.row(documents=self.documents, terms=self.terms)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as a table: rows of blocks (bits, keys, sizes, slices, texts), of term counts (words, df) and of totals (documents, terms).

    Written to the shared folder; it goes with the ``scratch`` block it is made in.
    """
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kinds = (
        f"bits int, keys array<{slim.schema['key'].dataType.simpleString()}>, sizes array<long>, slices binary, "
        "texts array<string>, words array<binary>, df array<long>, documents long, terms long"
    )
    fields = [("bits", pa.int32()), ("keys", None), ("sizes", pa.list_(pa.int64())), ("slices", pa.binary())]
    fields += [("texts", pa.list_(pa.string()))]
    fields += [("words", pa.list_(pa.binary())), ("df", pa.list_(pa.int64())), ("documents", pa.int64()), ("terms", pa.int64())]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if writer is None:
                writer = Writer(pa.schema([(n, t or pa.list_(batch.schema.field(0).type)) for n, t in fields]))
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(keys), 256):  # few texts at a time are Python strings
                for k, t in zip(keys[a : a + 256], texts.slice(a, 256).to_pylist()):
                    yield from writer.add(k, t)
        if writer is not None:
            yield from writer.rest()

    return written(slim.mapInArrow(write, kinds), "lexical-index", **LARGE_ROWS)


@dataclass
class Wanted:
    """Items searched together, with the weights of their terms and the totals of the documents."""

    items: list[list[bytes]]
    weights: dict[bytes, int]
    documents: int
    terms: int

    @cached_property
    def known(self) -> list[bytes]:
        """Terms that some document holds and that add to a score."""
        return [t for t, w in self.weights.items() if w > 0]

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.array([xxh64_intdigest(t) for t in self.known], np.uint64)

    @cached_property
    def parts(self) -> list[tuple[int, int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Ranges of terms with, for each item, the rows of its terms in the range and their weights."""
        place = {t: i for i, t in enumerate(self.known)}
        out = [(a, min(a + TOGETHER, len(place)), []) for a in range(0, len(place), TOGETHER)]
        for q, item in enumerate(self.items):
            rows = np.array(sorted(place[t] for t in item if t in place), np.int64)
            for a, b, held in out:
                mine = rows[(rows >= a) & (rows < b)]
                if len(mine):
                    held.append((q, mine - a, np.array([self.weights[self.known[r]] for r in mine], np.float64)))
        return out

    def norm(self, sizes):
        return 100 - 50 + (50 * sizes * self.documents) // self.terms

    def bounds(self, bits: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """The most that each document of a block can score for each item; whole numbers below 2^53."""
        table, docs = np.frombuffer(slices, np.uint8).reshape(bits, -1), len(sizes)
        norms = self.norm(sizes)
        most = np.minimum(np.array([1, *COUNTS[1:], 1 << 60])[:, None] - 1, sizes)  # of a term that reaches so many levels
        share = (1_000_000_000 * most) // (1000 * most + 20 * norms)
        total = np.zeros((len(self.items), docs))
        for a, b, held in self.parts:
            hashes = self.hashes[a:b]
            first = positions(hashes, 0, bits)
            row, col = np.nonzero(np.unpackbits(np.bitwise_and.reduce(table[first]), axis=1, count=docs))
            level, alive = np.ones(len(row), np.int64), np.arange(len(row))
            byte, shift = col >> 3, (7 - (col & 7)).astype(np.uint8)
            for l in range(1, len(COUNTS)):
                if not len(alive):
                    break
                at = positions(hashes, l, bits)[:, row[alive]]
                held_bits = np.bitwise_and.reduce(table[at, byte[alive]]) >> shift[alive] & 1
                alive = alive[held_bits == 1]
                level[alive] += 1
            adds = np.zeros((b - a, docs))
            adds[row, col] = share[level, col]
            for q, rows, weights in held:
                total[q] += weights @ adds[rows]
        return total

    def scores(self, text: str | None, wanted: list[int]) -> list[int]:
        """Exact scores of a text for some items."""
        found = Counter(terms(text))
        norm = self.norm(found.total())
        add = lambda t: self.weights[t] * ((1_000_000_000 * found[t]) // (1000 * found[t] + 20 * norm))
        return [sum(add(t) for t in self.items[q] if t in found) for q in wanted]


def best_bounds(index: DataFrame, wanted: Wanted, k: int, key_type: str) -> DataFrame:
    """(q, key, bound): for each task of the index, the ``k`` documents of highest bound of each item."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(len(wanted.items))
        held = [np.zeros(0, np.int64), np.zeros(0)]
        keys: list = []
        kind = pa.null()

        def pruned(held, keys):
            order = np.lexsort((-held[1], held[0]))
            q = held[0][order]
            first = np.searchsorted(q, q)
            order = order[np.arange(len(q)) - first < k]
            held = [x[order] for x in held]
            full = np.flatnonzero(np.bincount(held[0], minlength=len(least)) >= k)
            if len(full):
                least[full] = held[1][np.searchsorted(held[0], full, side="right") - 1]
            return held, [keys[i] for i in order]

        for bits, names, sizes, slices, _ in blocks_of(batches):
            kind, bounds = names.type, wanted.bounds(bits, sizes, slices)
            if len(sizes) > k:  # of a block, too, only k an item
                bounds[bounds < -np.partition(-bounds, k - 1, axis=1)[:, k - 1 : k]] = 0
            q, d = np.nonzero(bounds > least[:, None])
            names = names.to_pylist()
            held = [np.concatenate([held[0], q]), np.concatenate([held[1], bounds[q, d]])]
            keys += [names[i] for i in d]
            if len(keys) > 4 * k * len(least):
                held, keys = pruned(held, keys)
        if keys:
            held, keys = pruned(held, keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[0].astype(np.int32)), pa.array(keys, kind), pa.array(held[1].astype(np.int64))], names=["q", "key", "bound"]
            )

    return index.mapInArrow(find, f"q int, key {key_type}, bound long")


def not_excluded(index: DataFrame, wanted: Wanted, last: dict[int, tuple[int, object]], key_type: str) -> DataFrame:
    """(q, key, score) of all documents that their bound does not exclude, scored exactly, scores above 0.

    ``last``: for an item the score and key of a document that at least k documents equal or precede.
    """
    floor = np.array([max(last[q][0], 1) if q in last else 1 for q in range(len(wanted.items))], np.float64)[:, None]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bits, names, sizes, slices, texts in blocks_of(batches):
            bounds = wanted.bounds(bits, sizes, slices)
            open_ = bounds >= floor
            keys = names.to_pylist()
            for q, d in zip(*np.nonzero(bounds == floor)):
                if q in last and keys[d] is not None and last[q][1] is not None and keys[d] > last[q][1]:
                    open_[q, d] = False
            hits = []
            for d in np.flatnonzero(open_.any(axis=0)):
                asked = np.flatnonzero(open_[:, d]).tolist()
                hits += [(q, d, s) for q, s in zip(asked, wanted.scores(texts[int(d)].as_py(), asked)) if s > 0]
            if hits:
                q, d, scores = zip(*hits)
                columns = [pa.array(q, pa.int32()), names.take(pa.array(d, pa.int64())), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "key", "score"])

    return index.mapInArrow(find, f"q int, key {key_type}, score long")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, bytes, pa.Array]]:
    """The blocks of an index: bits, keys, sizes, bitmap, texts (where they are asked for)."""
    for batch in batches:
        for i in range(batch.num_rows):
            bits, keys, sizes, slices, *texts = (c[i] for c in batch.columns)
            yield bits.as_py(), keys.values, sizes.values.to_numpy(zero_copy_only=False), slices.as_buffer(), texts[0].values if texts else None


def rescored(docs: DataFrame, pairs: DataFrame, wanted: Wanted, key_type: str) -> DataFrame:
    """(q, key, score) of ``pairs`` (q, key), at most k for each of ``ITEMS`` items, from the whole texts; scores above 0.

    ``docs``: key, text.
    """
    by_key = pairs.groupBy("key").agg(F.collect_set("q").alias("qs"))
    met = docs.alias("d").join(F.broadcast(by_key).alias("p"), F.col("d.key").eqNullSafe(F.col("p.key"))).select("d.key", "d.text", "p.qs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in [(a, min(a + 256, batch.num_rows)) for a in range(0, batch.num_rows, 256)]:
                hits: list[tuple[int, int, int]] = []
                for i, (text, asked) in enumerate(zip(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist())):
                    for q, s in zip(asked, wanted.scores(text, asked)):
                        if s > 0:
                            hits.append((a + i, q, s))
                at, qs, scores = zip(*hits) if hits else ((), (), ())
                keys = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int32()), keys, pa.array(scores, pa.int64())], names=["q", "key", "score"])

    return met.mapInArrow(score, f"q int, key {key_type}, score long")


def ranked(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` rows of each item that are highest in ``by``, then lowest in key; ranked in parts first."""
    order = [F.col(by).desc(), F.col("key").asc_nulls_first()]
    part = F.pmod(F.xxhash64("key"), F.lit(DEALT))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order)))
    rows = rows.where(F.col("rank") <= k).drop("rank", "part")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def blocks_of_items(items: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Keys and distinct terms of items, ``ITEMS`` or about ``TERMS`` terms at a time; the driver holds one block."""
    names, found, size = [], [], 0
    for name, text in items.toLocalIterator():
        names.append(name)
        found.append(list(dict.fromkeys(terms(text))))
        size += len(found[-1])
        if len(names) >= ITEMS or size >= TERMS:
            yield names, found
            names, found, size = [], [], 0
    if names:
        yield names, found


def search_block(index: DataFrame, docs: DataFrame, found: list[list[bytes]], k: int, key_type: str) -> DataFrame:
    """(q, key, score, rank) of a block of items."""
    spark = docs.sparkSession
    documents, total = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(t for i in found for t in i)], "word binary")
    counts = index.where("words is not null").select(F.explode(F.arrays_zip("words", "df")).alias("x")).select(F.col("x.words").alias("word"), "x.df")
    counts = counts.join(F.broadcast(asked), "word").groupBy("word").agg(F.sum("df").alias("df"))  # at most TERMS and one item's
    weight = lambda df: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    wanted = Wanted(found, {bytes(r.word): weight(r.df) for r in counts.collect()}, documents, total)
    stored = index.where("slices is not null").select("bits", "keys", "sizes", "slices", "texts")

    likely = ranked(best_bounds(stored.drop("texts"), wanted, k, key_type), "bound", k).select("q", "key")
    seen = ranked(rescored(docs, likely, wanted, key_type), "score", k).where(F.col("rank") == k)
    limits = {r.q: r for r in seen.collect()}  # one row an item
    last = {q: (r.score, r.key) for q, r in limits.items()}
    return ranked(not_excluded(stored, wanted, last, key_type), "score", k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", index: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` best documents of each item: ``item``, ``rank`` from 1, ``key``, ``score``.

    ``index``: that of these documents, if there is one already.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    with scratch(spark):
        index = build_index(docs, key, text) if index is None else index
        slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        out = spark.createDataFrame([], f"item {items.schema[item].dataType.simpleString()}, rank int, key {kind}, score long")
        for names, found in blocks_of_items(items.select(F.col(f"`{item}`"), F.col(f"`{item_text}`"))):
            best = search_block(index, slim, found, k, kind)
            asked = spark.createDataFrame(list(enumerate(names)), f"q int, item {items.schema[item].dataType.simpleString()}")
            best = best.join(F.broadcast(asked), "q").select("item", F.col("rank").cast("int"), "key", "score")
            out = out.unionByName(written(best, "lexical-found"))
        found = written(out, "lexical", keep=True)
    return found.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
