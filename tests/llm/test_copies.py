"""Line runs, the Jaccard join, benchmark passages and fingerprints against brute force."""

import hashlib
import random

import pytest

from assayer.llm import components, decontaminate, fingerprint, jaccard, lineruns

LONG = " ".join(f"w{i}" for i in range(60))


def plain_deletions(rows, words):
    """Line numbers of each document that lie in a run of ``words`` words with an earlier copy."""
    docs = sorted({(k is not None, k or 0, t or "") for k, t in rows})
    lines = [(d, [(q, x) for q, x in enumerate(d[2].split("\n")) if x.strip()]) for d in docs]
    seen, gone = set(), {d: set() for d in docs}
    for d, own in lines:
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(x for _, x in own[a:b])
                if sum(len(x.split()) for x in run) >= words:
                    if run in seen:
                        gone[d] |= {q for q, _ in own[a:b]}
                    seen.add(run)
    return {(d[1] if d[0] else None, d[2]): sorted(g) for d, g in gone.items() if g}


def test_line_runs(frame):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 5))) for _ in range(6)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "x y z\nx y z\nx y z\nx y z"), (1000, "one line only")]
    want = plain_deletions(rows, 8)
    assert want
    out = lineruns.dedup(frame(rows), words=8).collect()
    assert len(out) == len(rows)
    for r in out:
        gone = want.get((r.doc_id, r.text or ""), [])
        assert (r.gone_lines or []) == gone, r
        if r.text is not None:
            assert r.kept == "\n".join(x for q, x in enumerate(r.text.split("\n")) if q not in gone)
    left = lineruns.deduped(frame(rows), words=8)
    assert left.columns == frame(rows).columns
    emptied = {r.doc_id for r in out if r.gone_lines and not r.kept.strip()}
    assert {r.doc_id for r in left.collect()} == {k for k, _ in rows} - emptied


def test_line_runs_of_repeated_rows_and_null_keys(frame):
    text = f"{LONG}\nshort"
    rows = [(None, text), (5, text), (5, text), (6, "head\n" + text)]
    out = [(r.doc_id, r.gone_lines) for r in lineruns.dedup(frame(rows)).collect()]
    assert sorted(out, key=str) == sorted([(None, None), (5, [0, 1]), (5, [0, 1]), (6, [1, 2])], key=str)
    assert lineruns.dedup(frame([])).collect() == []


def test_short_headers_stay(frame):
    rows = [(i, f"All rights reserved.\nbody {i} of the text") for i in range(20)]
    assert all(r.gone_lines is None for r in lineruns.dedup(frame(rows)).collect())


def plain_components(rows, size, num, den):
    def tokens(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [tokens(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (k, _), x in zip(rows, label):
        least[x] = min([v for v in (least.get(x), k) if v is not None], default=None)
    return [(k, len(s), least[x] if s else k) for (k, _), s, x in zip(rows, sets, label)]


def families(rng, many, size):
    """Copies of a few texts with 0 to 12 words changed, chains of single changes, and texts with one shared passage."""
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    passage = [rng.choice(words) for _ in range(40)]
    for _ in range(many):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 12)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((k, " ".join(own)))
            k += 1
        for _ in range(6):
            base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((k, " ".join(base).upper()))
            k += 1
        rows.append((k, " ".join(passage + [rng.choice(words) for _ in range(20)])))
        k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_components(frame, size, num):
    rows = families(random.Random(size), 12, 90) + families(random.Random(size + 1), 6, 20)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(9001, None), (9002, ""), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, " \n"), (9007, "a " * 30_000)]
    got = jaccard.joined(frame(rows), size=size, num=num, den=100).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(rows, size, num, 100))


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_copies_with_changes_of_their_own_are_not_compared_with_each_other(frame, monkeypatch, size, num):
    rng = random.Random(size)
    base, compared = [f"w{i}" for i in range(150)], []
    rows = [(5000, " ".join(base))]
    for k in range(160):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.randint(1, 9)):
            own[at] = f"x{k}-{at}"
        rows.append((k, " ".join(own)))
        if k % 10 == 0:  # links only to its like
            own[rng.randrange(len(own))] = "y"
            rows.append((1000 + k, " ".join(own)))
    checked = jaccard.checked
    monkeypatch.setattr(jaccard, "checked", lambda pairs, *a: compared.append(pairs.count()) or checked(pairs, *a))
    got = jaccard.joined(frame(rows), size=size, num=num, den=100).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(rows, size, num, 100))
    assert sum(compared) <= 4 * len(rows)


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_different_texts_do_not_meet_in_segments_without_shingles(frame, size, num):
    rng = random.Random(size)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 600)))) for k in range(200)]
    features = jaccard.featured(frame(rows), "doc_id", "text", size, jaccard.Sizes(num, 100)).localCheckpoint()
    assert jaccard.shared_segments(features).select("node").distinct().count() <= 20


@pytest.mark.parametrize("num", [90, 80, 60])
def test_similar_sets_agree_in_as_many_segments_as_counted(num):
    import numpy as np

    rng, sizes = np.random.default_rng(num), jaccard.Sizes(num, 100)
    met = 0
    for _ in range(400):
        n = int(rng.integers(2, 250))
        a = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        for gone in range(n):  # as different as similar sets can be
            both = n - gone
            more = both * 100 // num - n
            if more >= 0 and rng.random() < 0.2:
                b = np.r_[a[gone:], rng.integers(0, 2**63, more).astype(np.uint64) * np.uint64(2)]
                if gone + more:
                    one, two = ({int(s[0]) & 63: (set(s.tolist()), x) for s, x in sizes.segments(np.sort(v)) if len(s)} for v in (a, b))
                    shared = {c: len(one[c][0] & two[c][0]) for c in one if c in two}
                    assert any(m >= one[c][1] and m >= two[c][1] for c, m in shared.items())
                    met += 1
    assert met > 1000


def test_jaccard_of_repeated_rows_and_null_keys(frame):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (7, "A b c  d"), (8, "x")]
    got = jaccard.joined(frame(rows)).collect()
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == sorted([(None, 4), (4, 4), (4, 4), (7, 4), (8, 8)], key=str)
    kept = jaccard.representatives(frame(rows), size=3)
    assert kept.columns == frame(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 8]
    assert jaccard.joined(frame([])).collect() == []
    assert jaccard.representatives(frame([])).collect() == []


def test_sets_that_agree_in_no_segment_are_not_similar():
    """The bound behind the segments: as many differences as they allow leave one segment whole."""
    rng = random.Random(4)
    for num in (90, 80):
        sizes = jaccard.Sizes(num, 100)
        import numpy as np

        for _ in range(200):
            n = rng.randint(2, 400)
            a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            cut = rng.randint(0, n // 4)
            b = np.unique(np.r_[a[cut:], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, n // 8))], np.uint64)])
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= num * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                assert set(sizes.signatures(a).tolist()) & set(sizes.signatures(b).tolist())


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: x for n, x in label.items() if n != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_passages(frame, spark):
    rng = random.Random(7)
    items = [(i, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 40)))) for i in range(12)]
    items += [(50, "tiny"), (51, None), (52, ""), (53, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join("".join(rng.choice("uvwxyz") for _ in range(5)) for _ in range(30))
    rows, want = [(0, None), (1, ""), (2, filler)], {}
    for k in range(10, 110):
        i, passage = items[rng.randrange(12)]
        own = list(passage)
        for _ in range(rng.randint(0, len(own) // 30)):
            own[rng.randrange(len(own))] = rng.choice("uvw")
        shown = "".join(own).replace(" ", rng.choice([" ", "\n", "  "])).upper().replace("É", "é")
        rows.append((k, f"{filler} {shown} {filler}" if k % 3 else shown))
        want[k, i] = distance(decontaminate.normal(passage), decontaminate.normal(shown))
    rows.append((200, f"{filler} tiny {filler}"))
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_passages(frame(rows), benchmark).collect()}
    texts, allowed = dict(rows), decontaminate.Passages([(i, t) for i, t in items if t and len(t) > 20])
    budget = dict(zip(allowed.ids, allowed.edits.tolist()))
    for (k, i), d in want.items():
        assert ((k, i) in found) == (d <= budget[i]), (k, i, d)
        if (k, i) in found:
            r = found[k, i]
            part = decontaminate.normal(texts[k][r.start : r.end])
            assert r.edits <= d and distance(part, decontaminate.normal(dict(items)[i])) <= d + 1
    clean = {k for k, _ in rows} - {k for k, _ in found}
    assert {0, 1, 2} <= clean and (200, 50) in found
    assert all((k, 53) in found for k, i in found if i == 0)
    kept = decontaminate.without_passages(frame(rows), benchmark)
    assert {r.doc_id for r in kept.collect()} == clean and kept.columns == frame(rows).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_passages(frame(rows), none).collect() == []
    assert decontaminate.find_passages(frame([]), benchmark).collect() == []


@pytest.mark.parametrize("size", [12, 13, 14, 24, 25, 38, 50, 63, 81, 100, 150, 233, 400, 1000])
def test_passages_are_found_up_to_eight_percent_of_their_bytes(size):
    rng = random.Random(size)
    passage = "".join(rng.choice("abcdefghij") for _ in range(size))
    index, budget = decontaminate.Passages([(1, passage)]), size * 8 // 100
    for edits in {0, budget // 2, budget, budget + 1}:
        even = [size * (2 * i + 1) // (2 * edits) for i in range(edits)]  # spoils the most q-grams
        for places in (even, rng.sample(range(size), edits)):
            own = list(passage)
            for at in places:
                own[at] = rng.choice("xyz")
            found = index.scan([b"zyx " * 9, ("zyx " * 9 + "".join(own) + " zyx" * 9).encode()])
            assert [(t, i, k) for t, i, _, _, k in found] == ([(1, 1, edits)] if edits <= budget else []), edits


def test_passages_with_words_changed_or_accents_dropped(frame, spark):
    passage = "the señor café near the old harbour serves a fine crème brûlée to every guest who asks"
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    words = passage.replace("fine", "good").replace("old", "new")  # 7 bytes of 91
    bare = passage.replace("é", "e").replace("ñ", "n")  # 6 edits, two for each accent
    rows = [(1, f"before {words} after"), (2, bare), (3, words.replace("guest", "buyer")), (4, "the senor")]
    found = decontaminate.find_passages(frame(rows), benchmark).collect()
    assert {r.doc_id: r.edits for r in found} == {1: 7, 2: 6}
    assert {r.doc_id for r in decontaminate.without_passages(frame(rows), benchmark).collect()} == {3, 4}


def test_passages_in_blocks(frame, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    items = [(i, f"a passage number {i} that is long enough to be found by its q-grams {i * 7919}") for i in range(5)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"before {t} after") for i, t in items] + [(9, "before and after")]
    found = decontaminate.find_passages(frame(rows), benchmark).where("edits = 0").collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(5)]
    assert [r.doc_id for r in decontaminate.without_passages(frame(rows), benchmark).collect()] == [9]


def test_fingerprints(frame):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["aé", "b", "cc", "d😀"]) + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 400)))) for k in range(60)]
    rows += [(100, ""), (101, None), (102, "abc"), (103, rows[0][1]), (104, rows[0][1]), (105, " \n ")]
    out = {r.doc_id: r for r in fingerprint.fingerprints(frame(rows)).collect()}
    assert len(out) == len(rows)
    rows = [(k, t or "") for k, t in rows]
    for i, (k, text) in enumerate(rows):
        n, r = len(text) // 4, out[k]
        edited = text[: len(text) - n] + rows[(i + 1) % len(rows)][1][:n]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1

        def tokens(t):
            w = t.split()
            return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

        a, b = tokens(text), tokens(edited)
        if a and len(a) <= fingerprint.LEAST and len(b) <= fingerprint.LEAST:
            assert r.near_edited == pytest.approx(len(a & b) / len(a))
            assert r.jaccard_edited == pytest.approx(len(a & b) / len(a | b))
        elif a:
            assert abs(r.near_edited - len(a & b) / len(a)) < 0.3
    assert out[0].fingerprint == out[103].fingerprint == out[104].fingerprint != out[1].fingerprint
    assert out[103].near_next == 1.0 and out[100].near_next == 1.0


def test_fingerprints_of_repeated_rows_and_null_keys(frame):
    rows = [(None, "a b c d e f g h"), (1, "first text here"), (1, "first text here"), (1, "other"), (2, None)]
    out = fingerprint.fingerprints(frame(rows)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(k) for k, _ in rows)
    alone = fingerprint.fingerprints(frame([(3, "abcdefgh")])).collect()[0]
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprint.fingerprints(frame([])).collect() == []
