"""Secrets in texts: fixed patterns, and strings that a primed compressor cannot shorten.

Candidates are identifier-like strings that follow a sensitive word. Each is compressed by a
zstandard compressor primed with a dictionary of usual identifiers, once within its surroundings
and once without; the difference is what the string adds. A string that adds nearly a byte for
each of its characters is in neither the dictionary nor the surroundings and is reported.

A null text counts as empty. Texts are scanned whole and on their own, so repeated rows get equal
results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import with_fields

KINDS = ("assign", "access", "hex", "novel")
# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter one hides no longer one
SENSITIVE = re.compile(
    r"passw|pwd|passphrase|secret|token|api.?key|access.?key|private.?key|credential|bearer|signature|auth", re.A | re.I
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Characters between the end of a sensitive word and a candidate; characters of surroundings on
#: either side; added bytes per character from which a candidate is reported.
REACH, AROUND, NOVEL = 32, 200, 0.8
# Identifiers and phrases that stand near secrets without being any.
USUAL = (
    "password passwd secret token api_key apikey access_key private_key client_secret auth_token "
    "authorization bearer credentials username user_id session_id request_id account_name hostname "
    "localhost 127.0.0.1 example.com changeme placeholder your_password_here your-api-key REDACTED "
    "xxxxxxxxxxxx 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef "
    "const var let def return import from class public static void string integer boolean null true "
    "false none self config settings environment variable function parameter default value process.env "
    "os.environ getenv System.getProperty application/json content-type https:// http:// www. .com .org"
)


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(USUAL.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)


def added_bytes(before: str, candidate: str, after: str) -> int:
    """Bytes by which ``candidate`` lengthens the compressed surroundings."""
    size = _compressor().compress
    with_it = len(size((before + candidate + after).encode("utf-8", "replace")))
    return with_it - len(size((before + after).encode("utf-8", "replace")))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed patterns, failing matches dropped without a retry."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def mixed(s: str) -> bool:
    """A digit and a letter: a plain word or number is no secret."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def novel_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """Incompressible strings after a sensitive word that no base span overlaps."""
    found: dict[int, int] = {}
    for word in SENSITIVE.finditer(text):
        # a string may start within reach and end far beyond it
        for m in CANDIDATE.finditer(text, word.end()):
            if m.start() > word.end() + REACH:
                break
            start, end = m.span()
            if start in found or not mixed(m[0]) or any(s < end and start < e for s, _, e in base):
                continue
            added = added_bytes(text[max(0, start - AROUND) : start], m[0], text[end : end + AROUND])
            if added >= NOVEL * (end - start):
                found[start] = end
    return [(s, 3, e) for s, e in found.items()]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add counts of the base kinds, ``base_sha256`` of their spans, ``n_novel`` and all ``spans``."""
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part:
                t = t or ""
                base = base_spans(t)
                novel = novel_spans(t, base)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((*counts, digest, listed(base + novel), len(novel)))
            yield pd.DataFrame(rows, columns=names)

    return with_fields(df, run(F.col(text)), names)
