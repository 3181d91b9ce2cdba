"""Byte-pair encoding of words with ends, and decoding, by a priority queue over linked symbols.

A word's symbols form a doubly linked list. Every adjacent pair that has a merge rule waits in a
heap by (rank, place); the best one is merged, its neighbours' new pairs are pushed, and entries
whose symbols have changed meanwhile are skipped. Texts are normalised (NFC, lower case), cut at
special tokens and into words first; each task remembers the words it has met.

A null text counts as empty and has no tokens. Rows are encoded on their own, so repeated rows
and row order make no difference; very long words take n log n steps.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import with_fields
from assayer.llm.words import pieces

#: Words that a task keeps in each of its two tables.
REMEMBERED = 100_000
#: Texts, and about as many characters of them, whose ids and decoded text a task holds at a time.
AT_A_TIME = 500, 500_000
# The word pattern of the vocabulary file, spelled for the regex module. White space
# is listed by code point, since the two libraries differ on the separators U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it prints, else the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class _Words(dict):
    """Word -> (ids as text, decoded text), filled on demand.

    When full, the table becomes the ``older`` one; what is still in use moves over from there.
    """

    def __init__(self, codec: WordBpe):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            ids = self.codec.encode_word(word)
            out = (" ".join([str(i) for i in ids]), self.codec.decode(ids))
        self[word] = out
        return out


class WordBpe:
    """A vocabulary file of the BPE kind whose words end with a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        # pair -> rank and merged symbol in one number; ranks start at 1
        self.merges = {
            (self.ids[a], self.ids[b]): rank << 32 | self.ids[a + b]
            for rank, (a, b) in enumerate(model["merges"], 1)
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        letters = byte_letters()
        self.first = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.end] for c in letters]
        cut = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({cut})") if cut else None
        self.words = regex.compile(WORDS)
        self.odd = re.compile(r"[\x1c-\x1f]")  # white space for str.split, but not for the pattern
        self.known = _Words(self)

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        symbol = [self.first[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        size = len(symbol)
        rules = self.merges
        # An entry is rank and place in one number; the pair's rank tells whether it is stale.
        queue = [
            rules[pair] >> 32 << 32 | at for at, pair in enumerate(zip(symbol, symbol[1:])) if pair in rules
        ]
        if not queue:
            return symbol
        heapify(queue)
        after = [*range(1, size), -1]
        before = [*range(-1, size - 1)]
        while queue:
            entry = heappop(queue)
            at = entry & 0xFFFFFFFF
            other = after[at]
            if other < 0 or symbol[at] < 0:
                continue
            rule = rules.get((symbol[at], symbol[other]))
            if rule is None or rule >> 32 != entry >> 32:
                continue  # stale: one of the two has been merged since
            symbol[at], symbol[other] = merged, _ = rule & 0xFFFFFFFF, -1
            after[at] = right = after[other]
            left = before[at]
            if right >= 0:
                before[right] = at
                if rule := rules.get((merged, symbol[right])):
                    heappush(queue, rule >> 32 << 32 | at)
            if left >= 0 and (rule := rules.get((symbol[left], merged))):
                heappush(queue, rule >> 32 << 32 | left)
        return [s for s in symbol if s >= 0]

    def pieces(self, text: str) -> Iterator[str]:
        """Words and special tokens of a text, in order."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield part
            elif part:
                yield from self.split(self._normal(part))

    def split(self, text: str) -> list[str]:
        """Words of a normalised text. Letters alone, or before usual end marks, need no pattern."""
        if self.odd.search(text):
            return self.words.findall(text)
        out: list[str] = []
        for chunk in text.split():
            if chunk.isalpha():
                out.append(chunk)
                continue
            core = chunk.rstrip(".,;:!?")
            if core.isalpha():
                out.append(core)
                out.append(chunk[len(core) :])
            else:
                out.extend(self.words.findall(chunk))
        return out

    def _normal(self, text: str) -> str:
        if not text.isascii():
            # a final sigma is lower-cased like any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            out.extend([self.special[piece]] if piece in self.special else self.encode_word(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, joined by spaces: the file names no decoder that would join them tighter."""
        return " ".join([self.strings[i] for i in ids])

    def both(self, text: str) -> tuple[str, str]:
        """Ids joined by a space, and the decoded text."""
        known, ids, back = self.known, [], []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(str(self.special[part]))
                back.append(part)
            elif part:
                found = [known[w] for w in self.split(self._normal(part))]
                ids.extend([x[0] for x in found])
                back.extend([x[1] for x in found])
        return " ".join(ids), " ".join(back)


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``token_ids`` (joined by a space), ``n_tokens`` and ``decoded`` of every text."""

    @F.pandas_udf("token_ids string, n_tokens long, decoded string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = codec(path)
        for part in parts:
            rows = [bpe.both(t or "") for t in part]
            yield pd.DataFrame(
                {
                    "token_ids": [ids for ids, _ in rows],
                    "n_tokens": [ids.count(" ") + 1 if ids else 0 for ids, _ in rows],
                    "decoded": [back for _, back in rows],
                }
            )

    return with_fields(df, run(F.col(text)), ["token_ids", "n_tokens", "decoded"])


def encode_ids(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``token_ids`` (numbers), ``n_tokens`` and the SHA-256 of ids and decoded text."""
    names = ["token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]

    @F.arrow_udf("token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(path)
        for part in parts:
            for texts in pieces(part, *AT_A_TIME):
                yield _numbers(bpe, texts)

    return with_fields(df, run(F.col(text)), names)


def _numbers(bpe: WordBpe, texts: list[str | None]) -> pa.Array:
    both = [bpe.both(t or "") for t in texts]
    numbers = [np.array(ids.split(), np.int32) for ids, _ in both]
    many = np.array([len(n) for n in numbers], np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(np.concatenate(numbers)))
    digests = [pa.array([_sha256(pair[k]) for pair in both], pa.string()) for k in (0, 1)]
    return pa.StructArray.from_arrays([lists, pa.array(many), *digests], ["token_ids", "n_tokens", "ids_sha256", "decoded_sha256"])


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and the SHA-256 of ids and decoded text; the ids stay inside the task."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = codec(path)
        for part in parts:
            rows = []
            for t in part:
                ids, back = bpe.both(t or "")
                rows.append((ids.count(" ") + 1 if ids else 0, _sha256(ids), _sha256(back)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return with_fields(df, run(F.col(text)), ["n_tokens", "ids_sha256", "decoded_sha256"])
