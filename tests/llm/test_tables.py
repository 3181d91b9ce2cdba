"""Manifest, mix and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.llm import lexical, merkle, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, at string, score string, q int"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents from (doc_id, text, lang, source, n_chars), with further columns whose names clash with those inside."""
    return lambda rows: spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


# ---------------------------------------------------------------- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    values = [doc_id, source, lang, None if n is None else n + more, text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, i):
    """Root of a run of digests and, level by level, (sibling or None, whether it is on the left) of place ``i``."""
    path = []
    while len(nodes) > 1:
        path.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, i & 1 == 1))
        nodes, i = [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)], i >> 1
    return nodes[0], path


def manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    first = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    runs = {g: sorted((r for r in rows if r[2] == g), key=first) for g in langs}
    tops = {g: climb([leaf(r) for r in run], 0)[0] for g, run in runs.items()}
    out = []
    for at, (g, run) in enumerate(runs.items()):
        root, upper = climb(list(tops.values()), at)
        for i, r in enumerate(run):
            path = climb([leaf(x) for x in run], i)[1] + upper
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, tampered)
            for sibling, left in path:
                folded = digest(folded) if sibling is None else digest(sibling, folded) if left else digest(folded, sibling)
            proof = digest(*[s for s, _ in path if s is not None])
            out.append((r[0], leaf(r), tops[g], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def tampered():
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    return {"n_chars": F.col("n_chars").cast("decimal(20,0)") + more}


def some_rows(n, seed):
    r = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", None]
    return [(r.randrange(10**6), r.choice([None, "", "x" * r.randrange(50), "ß日"]), r.choice(langs), r.choice([None, "a", "b"]), r.choice([None, 0, 7])) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 40, 700])
def test_manifest(docs, n):
    rows = some_rows(n, n)
    rows += rows[:2] + ([(None, "t", None, None, 1), (7, "a", "en", None, None), (7, "b", "en", None, None)] if n > 3 else [])
    assert sorted(map(tuple, merkle.manifest(docs(rows), tampered=tampered()).collect()), key=repr) == manifest(rows)


def test_manifest_over_lanes_and_many_rounds(docs, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    monkeypatch.setattr(merkle, "LANE", 3)
    rows = some_rows(150, 5) + [(i, "t", f"l{i}", None, 1) for i in range(30)]
    assert sorted(map(tuple, merkle.manifest(docs(rows), tampered=tampered()).collect()), key=repr) == manifest(rows)


def test_manifest_of_nothing_and_of_one_long_row(docs):
    assert merkle.manifest(docs([]), tampered=tampered()).collect() == []
    row = (14, "long " * 200_000, None, None, 2**63 - 1)
    assert [tuple(r) for r in merkle.manifest(docs([row]), tampered=tampered()).collect()] == manifest([row])


# ---------------------------------------------------------------- mix


def water_filled(sizes, total):
    """Targets by rounds of clamping and sharing; ``sizes``: (size, weight)."""
    clamped = set()
    while True:
        rest = total - sum(3 * sizes[i][0] for i in clamped)
        open_ = sum(w for i, (_, w) in enumerate(sizes) if i not in clamped)
        share = [3 * s if i in clamped else rest * w / open_ for i, (s, w) in enumerate(sizes)]
        over = {i for i, (s, _) in enumerate(sizes) if i not in clamped and share[i] > 3 * s}
        if not over:
            return share
        clamped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix(docs, seed):
    r = random.Random(seed)
    sources = [None, "a", "b", "é", "Z", "hot", "void"]
    rows = [(i // 2 if i % 9 == 0 else i, r.choice([None, "", " \t"]) if s == "void" else "w " * r.choice([0, 1, 5, 300]), "en", s, 1) for i, s in enumerate(r.choices(sources, [1, 3, 9, 2, 1, 40, 2], k=400))]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    names = sorted({x[3] for x in rows}, key=lambda x: (x is None, (x or "").encode()))
    sizes = [(sum(len((x[1] or "").split()) for x in rows if x[3] == n), 1 + i % 3) for i, n in enumerate(names)]
    total = sum(s for s, _ in sizes)
    for name, (size, _), want in zip(names, sizes, water_filled(sizes, total)):
        mine = [x for x in got if x.source == name]
        assert {x.source_size for x in mine} == {size}
        assert all(x.target == pytest.approx(want) for x in mine)
        assert want - 1 < sum(x.taken for x in mine) <= want + 1e-6
        assert all(0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size + x.part for x in mine)
        assert sum(0 < x.part < x.size for x in mine) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs(rows).repartition(7)).collect()))


def test_mix_of_nothing_and_of_another_size(docs):
    assert mixing.mix(docs([])).collect() == []
    assert [x.taken for x in mixing.mix(docs([(1, None, "en", None, 1)])).collect()] == [0]
    rows = [(1, "a b c d", "en", "s", 1), (2, "a " * 100_000, "en", "t", 1)]
    got = {x.doc_id: x.taken for x in mixing.mix(docs(rows), total=30, weights=[1], epochs=2).collect()}
    assert got == {1: 8, 2: 22}


# ---------------------------------------------------------------- search


def terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def searched(rows, items, k):
    found = [(r[0], terms(r[1])) for r in rows]
    n_docs, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    out = []
    for name, text in items:
        scores = []
        for key, words in found:
            score = 0
            for t in set(terms(text)):
                if tf := words.count(t):
                    df = sum(t in w for _, w in found)
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += weight * (10**9 * tf // (1000 * tf + 20 * (50 + 50 * len(words) * n_docs // total)))
            if score:
                scores.append((-score, key is not None, key or 0))
        out += [(name, i, key if some else None, -s) for i, (s, some, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


WORDS = ["the", "The", "of", "éclair", "ÉCLAIR", "straße", "x1", "日本", "co-op", "a_b", "it's"] + [f"w{i}" for i in range(60)]


def a_text(r):
    return r.choice([" ", ", ", "\n"]).join(r.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=r.choice([0, 1, 8, 60, 400])))


@pytest.mark.parametrize(("k", "items_at_once", "part"), [(5, 2048, 2048), (50, 3, 4), (1, 1, 7)])
def test_search(spark, docs, monkeypatch, k, items_at_once, part):
    monkeypatch.setattr(lexical, "ITEMS", items_at_once)
    monkeypatch.setattr(lexical, "TOGETHER", part)
    r = random.Random(k)
    rows = [(i, a_text(r), "en", None, 1) for i in range(150)]
    rows += [(1000 + i, rows[3][1], "en", None, 1) for i in range(60)] + [(9, "w1 w2", "en", None, 1), (None, "w1 w2", "en", None, 1), (None, None, "en", None, 1)]
    items = [(i, a_text(r)[:80]) for i in range(6)] + [(20, None), (21, "..."), (22, "unseen"), (None, "w1 w2 unseen"), (23, rows[3][1])]
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")
    got = sorted(map(tuple, lexical.search(docs(rows), frame, k).collect()), key=repr)
    assert got == searched(rows, items, k)


def test_search_without_documents_or_items_and_in_a_long_text(spark, docs):
    frame = spark.createDataFrame([(1, "needle in straw")], "item_id long, text string")
    assert lexical.search(docs([]), frame).collect() == []
    assert lexical.search(docs([(1, None, "en", None, 1)]), frame).collect() == []
    assert lexical.search(docs([(1, "needle", "en", None, 1)]), frame.where("false")).collect() == []
    long = " ".join(f"s{i}" for i in range(120_000)) + " needle"
    rows = [(1, long, "en", None, 1), (2, "needle", "en", None, 1), (3, "hay", "en", None, 1)]
    assert sorted(map(tuple, lexical.search(docs(rows), frame).collect()), key=repr) == searched(rows, [(1, "needle in straw")], 50)


def test_bounds_are_never_below_scores():
    r = random.Random(8)
    texts = [a_text(r) or "the" for _ in range(300)]
    counted = [lexical.Counter(lexical.terms(t)) for t in texts]
    arrays = [(np.array([lexical.xxh64_intdigest(t) for t in c], np.uint64), np.array(list(c.values()))) for c in counted]
    sizes = np.array([c.total() for c in counted])
    items = [lexical.terms(a_text(r)) for _ in range(5)]
    items = [list(dict.fromkeys(i)) for i in items]
    wanted = lexical.Wanted(items, {t: 100 + len(t) for i in items for t in i}, 300, int(sizes.sum()))
    bits = max(lexical.signature_bits(c) for _, c in arrays)
    bounds = wanted.bounds(bits, sizes, lexical.sliced(bits, arrays))
    exact = np.array([wanted.scores(t, list(range(5))) for t in texts]).T
    assert (bounds >= exact).all() and (bounds == exact).mean() > 0.2


def test_index_rows_do_not_pile_up_in_one_row_group(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"{rng.getrandbits(48):x}" for _ in range(26_000))) for k in range(100)]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in index.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) > 20
    assert max(f.metadata.row_group(i).total_byte_size for f in files for i in range(f.metadata.num_row_groups)) < 24 << 20
