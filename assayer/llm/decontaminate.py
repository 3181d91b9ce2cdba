"""Benchmark passages in documents, by q-gram counting in diagonal bands and banded alignment.

Texts are compared with A-Z in lower case and every run of white space as one space. A passage of m
bytes may differ by k = ``EDITS`` * m edits, rounded down. The lemma: of its m - q + 1 q-grams at most
k * q are touched by k edits, and the others lie in the text within k diagonals of each other. So
hits are counted per document, passage and band of 2(k + 1) diagonals, where bands overlap by half;
bands with fewer than m - q + 1 - k * q hits are dropped. What is left is aligned within its band, and
regions of more than k edits are dropped as well. Each passage has the largest q of up to ``Q`` for which
that bound is above a share ``SPARE`` of m, so no budget is cut for it.

Passages shorter than ``Q`` may not differ and are looked for letter by letter; empty or null passages and texts match
nothing. The passages are taken in blocks of ``BLOCK``, each of which is sent to all tasks, and
documents stay where they are: nothing is shuffled. Repeated rows get equal results, and a passage
that stands in the benchmark twice is reported for both.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.words import chunks

#: Bytes in a q-gram at most, edits per byte, passages in a block (under 1 KB each in the index on average).
Q, EDITS, BLOCK = 12, 0.08, 4096
#: Share of a passage's bytes that the bound on hits exceeds; cells of the alignment table of one call.
SPARE, CELLS = 1 / 16, 1 << 20
_BITS = 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FAR = np.int64(1) << 40


def normal(text: str | None) -> bytes:
    raw = b" ".join((text or "").encode("utf-8", "replace").lower().split())
    return raw.replace(b"\0", b"\1") if b"\0" in raw else raw


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the ``q`` bytes, 4 to 12, from every place of ``data`` on."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << 8
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << 16
    first = four.astype(np.uint64)
    if q >= 8:
        first = first[:-4] | first[4:] << np.uint64(32)
    with np.errstate(over="ignore"):
        mixed = (first[: len(data) - q + 1] ^ four[q - 4 :].astype(np.uint64) * _B) * _A
    return mixed ^ mixed >> np.uint64(29)


class Grams:
    """q-gram hash -> (passage, place) for the passages of one q."""

    def __init__(self, q: int, items: list[int], data: list[np.ndarray]):
        self.q = q
        every = [grams(data[i], q) for i in items]
        flat = np.concatenate(every)
        order = np.argsort(flat, kind="stable")
        self.gram = flat[order]
        self.item = np.repeat(items, [len(g) for g in every])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in every])[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, passage, place in the passage) of every shared q-gram."""
        g = grams(data, self.q)
        at = np.flatnonzero(self.seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        low = np.searchsorted(self.gram, g[at], "left")
        many = np.searchsorted(self.gram, g[at], "right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        where = np.repeat(low, many) + within
        return np.repeat(at, many), self.item[where], self.place[where]


class Passages:
    """Index of one block of passages."""

    def __init__(self, items: list[tuple[int, str | None]]):
        texts = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.short = [(i, t) for i, t in texts if len(t) < Q]
        texts = [(i, t) for i, t in texts if len(t) >= Q]
        self.ids = [i for i, _ in texts]
        self.data = [np.frombuffer(t, np.uint8) for _, t in texts]
        self.size = np.array([len(t) for _, t in texts], np.int64)
        self.edits = np.floor(self.size * EDITS + 1e-9).astype(np.int64)
        q = np.minimum(Q, np.floor(self.size * (1 - SPARE) + 1).astype(np.int64) // (self.edits + 1))
        self.need = self.size - q + 1 - self.edits * q
        self.parts = [Grams(n, np.flatnonzero(q == n).tolist(), self.data) for n in sorted(set(q.tolist()))]

    def regions(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, passage, lowest and highest start) of band groups that meet the lemma's bound."""
        return [r for part in self.parts for r in self.regions_of(part, data, starts)]

    def regions_of(self, part: Grams, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        at, item, place = part.hits(data)
        if not len(at):
            return []
        text = np.searchsorted(starts, at, "right") - 1
        diagonal = at - place - starts[text] + self.size[item]  # never negative
        width = self.edits[item] + 1
        both = [np.concatenate([v, v]) for v in (text, item)]
        band = np.concatenate([diagonal // width, diagonal // width - 1])
        order = np.lexsort((band, both[1], both[0]))
        text, item, band = both[0][order], both[1][order], band[order]
        first = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)])
        count = np.diff(np.r_[first, len(band)])
        text, item, band = text[first], item[first], band[first]
        kept = count >= self.need[item]
        text, item, band = text[kept], item[kept], band[kept]
        out: list[tuple[int, int, int, int]] = []
        for t, i, b in zip(text.tolist(), item.tolist(), band.tolist()):
            step = int(self.edits[i]) + 1
            low, high = b * step - int(self.size[i]), (b + 2) * step - int(self.size[i])
            if out and out[-1][:2] == (t, i) and low <= out[-1][3]:
                out[-1] = (t, i, out[-1][2], high)
            else:
                out.append((t, i, low, high))
        return out

    def aligned(self, texts: list[bytes], found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """(text, passage, start, end, edits) of the regions that hold their passage within its edits.

        All regions of a call advance together: row i of the table has, for every region, the cost
        of the passage's first i bytes against the text up to each diagonal of the band, and where
        that match starts. Costs stand in the upper bits, starts in the lower.
        """
        if not found:
            return []
        edits = self.edits[[i for _, i, _, _ in found]]
        low = np.array([a for _, _, a, _ in found]) - edits
        high = np.array([b for _, _, _, b in found]) + edits
        width, rows = int((high - low).max()) + 1, int(self.size[[i for _, i, _, _ in found]].max())
        pattern = np.zeros((len(found), rows), np.int16) - 1
        window = np.zeros((len(found), rows + width + 1), np.int16) - 2
        for r, (t, i, _, _) in enumerate(found):
            pattern[r, : self.size[i]] = self.data[i]
            a, b = int(low[r]), int(low[r]) + rows + width + 1
            piece = np.frombuffer(texts[t][max(a, 0) : max(b, 0)], np.uint8)
            window[r, max(-a, 0) : max(-a, 0) + len(piece)] = piece
        slope = np.arange(width, dtype=np.int64) * _FAR
        cost = np.tile(np.arange(width, dtype=np.int64), (len(found), 1))
        inside = (low[:, None] + np.arange(width)) <= high[:, None]
        cost[~inside] += _FAR << 20
        size = self.size[[i for _, i, _, _ in found]]
        final = np.zeros_like(cost)
        for i in range(rows):
            step = cost + np.where(window[:, i : i + width] == pattern[:, i : i + 1], 0, _FAR)
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + _FAR)
            cost = np.minimum.accumulate(step - slope, axis=1) + slope
            done = size == i + 1
            final[done] = cost[done]
        best = final.argmin(axis=1)
        out = []
        for r, (t, i, _, _) in enumerate(found):
            value = int(final[r, best[r]])
            errors, offset = divmod(value, int(_FAR))
            start, end = int(low[r]) + offset, int(low[r]) + int(best[r]) + int(size[r])
            if errors <= self.edits[i]:
                out.append((t, i, max(start, 0), min(end, len(texts[t])), errors))
        return out

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, passage id, start, end, edits) of all passages, places in normalised bytes."""
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
        out, found = [], self.regions(data, starts) if self.ids else []
        span = lambda r: r[3] - r[2] + 2 * int(self.edits[r[1]]) + 1
        found.sort(key=lambda r: (span(r), self.size[r[1]]))  # a call's table is as large as its widest and longest region
        while found:
            n = min(256, max(1, CELLS // span(found[-1])))
            out += [(t, self.ids[i], s, e, k) for t, i, s, e, k in self.aligned(texts, found[-n:])]
            del found[-n:]
        for i, passage in self.short:
            out += [(t, i, m.start(), m.end(), 0) for t, x in enumerate(texts) for m in re.finditer(re.escape(passage), x)]
        return out


def code_points(text: str, places: list[int]) -> list[int]:
    """Places in the normalised bytes of ``text`` as code points of ``text`` itself."""
    raw, ends, at = text.encode("utf-8", "replace"), [], []
    size = 0
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
        at.append((size, m.start()))
        ends.append(size := size + m.end() - m.start() + 1)
    out = []
    for p in places:
        n, r = at[max(0, bisect_right(at, (p, 1 << 60)) - 1)] if at else (0, 0)
        out.append(len(raw[: r + p - n].decode("utf-8", "ignore")))
    return out


def blocks(benchmark: DataFrame, item: str, item_text: str) -> Iterator[Passages]:
    """Indexes of ``BLOCK`` passages each; the driver holds one block at a time."""
    rows = ((str(i) if i is not None else None, t) for i, t in benchmark.select(item, item_text).toLocalIterator())
    while block := list(islice(rows, BLOCK)):
        yield Passages(block)


def without_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold none of the passages; nothing is moved."""
    for sent in blocks(benchmark, item, item_text):

        def keep(batches: Iterator[pa.RecordBatch], sent: Passages = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, kept = batch.column(text).to_pylist(), np.ones(batch.num_rows, bool)
                for a, b in chunks(texts):
                    kept[[a + t for t, *_ in sent.scan([normal(x) for x in texts[a:b]])]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def find_passages(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per passage found: ``key``, ``item``, code point ``start`` and ``end``, ``edits``.

    ``key`` and ``item`` keep their types.
    """
    out, slim = None, docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`"))
    kinds = f"{key} {docs.schema[key].dataType.simpleString()}, _item string, start long, end long, edits int"
    for sent in blocks(benchmark, item, item_text):

        def search(batches: Iterator[pa.RecordBatch], sent: Passages = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, kept, found = batch.column(1).to_pylist(), [], []
                for a, b in chunks(texts):
                    by_text: dict[int, list] = {}
                    for t, i, s, e, k in sent.scan([normal(x) for x in texts[a:b]]):
                        by_text.setdefault(a + t, []).append((i, s, e, k))
                    for t, hits in by_text.items():
                        points = code_points(texts[t], [p for _, s, e, _ in hits for p in (s, e)])
                        kept += [t] * len(hits)
                        found += [(i, points[2 * n], points[2 * n + 1], k) for n, (i, _, _, k) in enumerate(hits)]
                if kept:
                    columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(kept)), *columns], names=[key, "_item", "start", "end", "edits"]
                    )

        part = slim.mapInArrow(search, kinds)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], kinds)
    return out.select(
        key, F.col("_item").cast(benchmark.schema[item].dataType).alias(item), "start", "end", "edits"
    )
