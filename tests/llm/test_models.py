"""Archives, toxicity, resampling and the pipeline."""

import base64
import hashlib
import io
import random
import tracemalloc
import zipfile

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import bpe, resample, toxicity, warczip
from assayer.llm.words import pieces
from assayer.session import fresh_path


def reader(data):
    return lambda at, length: data[at : at + length]


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"\n", b"PK\5\6 is no end record " * 3])
def test_zip_directories(zip64, comment):
    content = {"a/b.txt": b"hello", "empty": b"", "é.bin": bytes(range(256)) * 50}
    data = warczip.pack(content.items(), zip64=zip64, comment=comment)
    found = warczip.members(reader(data), len(data))
    assert list(found) == list(content)
    for name, member in found.items():
        at = warczip.stored_at(reader(data), member)
        assert data[at : at + member.size] == content[name]
    if b"PK" in comment:  # the reader of the standard library takes the comment for the record
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == content


def test_zip_written_by_another_program():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(70_000):  # more members than the short end record can count
            z.writestr(f"{i}", b"")
        with z.open(zipfile.ZipInfo("large"), "w", force_zip64=True) as f:
            f.write(b"x" * 1000)
    data = out.getvalue()
    found = warczip.members(reader(data), len(data))
    assert len(found) == 70_001
    at = warczip.stored_at(reader(data), found["large"])
    assert data[at : at + 1000] == b"x" * 1000


def test_no_zip_and_compressed_members():
    with pytest.raises(ValueError, match="no ZIP file"):
        warczip.members(reader(b"x" * 100), 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 100)
    data = out.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        warczip.stored_at(reader(data), warczip.members(reader(data), len(data))["a"])


def test_packages_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warczip, "RANGE", 3000)
    large, other = "<p>é" * 400, "y" * 1000
    rows = [(i, f"http://h/{i}", large) for i in range(40)] + [(i, "u\r\nX: y", f"small {i % 3}") for i in range(40, 60)]
    rows += [(60, None, None), (61, "u", ""), (62, "u", other), (63, "u", other), (63, "u", other), (None, "u", other), (None, "u", "z" * 2000), (64, "u", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = fresh_path(spark, "packages-test")
    warczip.write_packages(warczip.with_types(pages), path)
    got = warczip.read_packages(spark, path).collect()
    assert len(got) == len(rows)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        first = max(same, default=None)
        revisit = len(body) >= 1000 and first is not None and i != first
        want.append((str(i) if i is not None else None, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", str(first) if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    by_id = {str(i): h or "" for i, _, h in rows}
    assert all(r.payload == by_id[r.page_id] for r in got if r.page_id and r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.url for r in got if r.page_id == "45"} == {"u X: y"}


def test_packages_of_no_pages(spark):
    path = fresh_path(spark, "packages-test")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warczip.write_packages(warczip.with_types(pages), path)
    assert warczip.read_packages(spark, path).collect() == []


def test_a_changed_body_is_noticed(spark):
    digest = base64.b32encode(b"\0" * 20).decode()
    row = {"page_id": "1", "url": "u", "payload": "abc", "record_type": "response", "payload_digest": "00" * 20, "refers_to": None, "payload_bytes": 3}
    fields, body = warczip.parsed(warczip.record(row, "2024-01-01T00:00:00Z"))
    assert body == b"abc" and fields["WARC-Payload-Digest"] == f"sha1:{digest}"


def invented(rng, many, bad=("awful", "nastier", "vilest")):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    texts, labels = [], []
    for i in range(many):
        own = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        if i % 3 == 0:
            own[rng.randrange(len(own))] = rng.choice(bad) + rng.choice(["", ".", "s"])
        texts.append(" ".join(own))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_windows_cover_every_word():
    ends = np.array([0, 0, 1, 24, 25, 50, 500])
    at, inside, text = toxicity.windows(ends)
    for t in range(len(ends) - 1):
        seen = at[text == t][inside[text == t] > 0]
        assert set(seen.tolist()) == set(range(ends[t], ends[t + 1]))


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vectors = rng.standard_normal((9, toxicity.VECTOR))
    at, inside, text = toxicity.windows(np.array([0, 5, 40, 41]))
    at, label = at % 9, np.array([1.0, 0.0, 1.0])
    inside = inside.astype(np.float64)
    g, dvectors, _ = net.gradients(vectors, at, inside, text, label)

    def slope(array, place, by=1e-2):
        array[place] += by
        up = net.gradients(vectors, at, inside, text, label)[2]
        array[place] -= 2 * by
        down = net.gradients(vectors, at, inside, text, label)[2]
        array[place] += by
        return (up - down) / (2 * by)

    for name in ("xf", "hf", "hb", "bb", "attend", "focus", "out"):
        place = tuple(rng.integers(0, n) for n in net.p[name].shape)
        assert slope(net.p[name], place) == pytest.approx(g[name][place], rel=0.05, abs=2e-4), name
    assert slope(vectors, (4, 3)) == pytest.approx(dvectors[4, 3], rel=0.05, abs=2e-4)


def test_toxicity_on_held_out_texts(frame, spark):
    texts, labels = invented(random.Random(1), 450)
    rows = list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, "plain " * 5000 + "awful " + "plain " * 5000)]
    known = [(i, y) for i, y in enumerate(labels) if i % 5] + [(9100, None), (1, labels[1])]
    out = toxicity.scored(frame(rows), spark.createDataFrame(known, "doc_id long, toxic int")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [i for i in range(450) if i % 5 == 0]
    right = np.mean([got[i].predicted == labels[i] for i in held])
    assert right > 0.9
    assert got[9000].score == got[9001].score == 0


def test_toxicity_without_labels(frame, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scored(frame([(1, "a"), (1, "a")]), none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert len(toxicity.scored(frame([(1, "a b"), (2, "c"), (None, None)]), one).collect()) == 3
    assert toxicity.scored(frame([]), one).collect() == []


def test_scoring_holds_little_at_a_time():
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(32):x}" for _ in range(250)) for _ in range(900)]  # 2 MB, no word twice
    scorer = toxicity.Scorer(toxicity.Network(1))
    tracemalloc.start()
    parts = [scorer.scores(part) for part in pieces(pa.array(texts))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6
    few = [*range(0, 900, 100)]
    alone = [toxicity.Scorer(scorer.net).scores([texts[i]])[0] for i in few]
    assert np.concatenate(parts)[few] == pytest.approx(alone, abs=1e-6)


def test_words_beyond_the_table(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    monkeypatch.setattr(toxicity, "LOOKED_UP", 7)
    long = " ".join(f"w{i}" for i in range(90))
    texts = [" ".join(f"v{i}" for i in range(k, k + 15)) for k in range(0, 90, 5)] + [long, None, "", "a b", *["a b c"] * 3]
    scorer = toxicity.Scorer(toxicity.Network(2))
    got = np.concatenate([scorer.scores([t]) for t in texts])
    together = toxicity.Scorer(scorer.net).scores(texts)
    assert got == pytest.approx(together, abs=1e-6) and got[19] == got[20] == 0 < got[18]
    assert got[-1] == got[-2] == got[-3] and len(scorer.gates["f"]) == 20


def test_columns_are_cut_in_order():
    texts = [None, "", "é" * 300_000, "a", *["b" * 1000] * 1200, None]
    found = list(pieces(pa.array(texts).slice(1), 500, 500_000))
    assert [t for part in found for t in part] == texts[1:] and max(len(part) for part in found) == 500
    assert list(pieces(pa.array([], pa.string()))) == []


def test_ids_of_many_texts(frame):
    texts = [None, "", "  ", "Hello, world!"] + [f"text {i} of many, ünïcode {i * i}" * (i % 4) for i in range(1300)]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r for r in bpe.encode_ids(frame(list(enumerate(texts))).coalesce(1), path).collect()}
    codec = bpe.WordBpe(path)
    for i, t in enumerate(texts):
        ids = codec.encode(t or "")
        assert (got[i].token_ids, got[i].n_tokens) == (ids, len(ids))
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def test_log_weights_are_those_of_the_counts(frame):
    docs = frame([(1, "a b a"), (2, None), (3, ""), (4, "c c"), (5, "a b a")])
    target = frame([(1, "a b a")])
    got = {r.doc_id: r.log_weight for r in resample.log_weights(docs, target).collect()}
    bucket = {g: int(resample.ngrams([g], resample.WordHashes())[0][-1]) for g in ("a", "b", "c", "a b", "b a", "c c")}
    many = {g: (2 * n, m) for g, n, m in [("a", 2, 2), ("b", 1, 1), ("a b", 1, 1), ("b a", 1, 1)]} | {"c": (2, 0), "c c": (1, 0)}
    assert len(set(bucket.values())) == 6
    raw, wanted = 13 + resample.BUCKETS, 5 + resample.BUCKETS
    ratio = {g: np.log((m + 1) / wanted) - np.log((n + 1) / raw) for g, (n, m) in many.items()}
    assert got[1] == got[5] == pytest.approx(2 * ratio["a"] + ratio["b"] + ratio["a b"] + ratio["b a"])
    assert got[4] == pytest.approx(2 * ratio["c"] + ratio["c c"]) and got[2] == got[3] == 0


def test_resampling(frame, spark):
    good, bad = "the river runs along the old town wall", "zz%% qq$$ zz%% qq$$ zz%% qq$$"
    rows = [(i, good + f" {i % 7}" if i % 4 else bad + f" {i % 5}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)] + [(500, None)], "doc_id long, quality int")
    out = resample.resample(frame(rows), labels)
    drawn = out.collect()
    assert sorted(r.draw for r in drawn) == list(range(1, 151))
    assert np.mean([r.doc_id % 4 > 0 for r in drawn]) > 0.95
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, resample.resample(frame(rows), labels).collect()))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len(resample.resample(frame(rows[:10] + rows[:10]), none, share=0.5).collect()) == 10
    assert resample.resample(frame([]), labels).collect() == []


def test_gumbel_draws_in_proportion(spark):
    weighted = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, np.log(3.0)).otherwise(0.0).alias("log_weight"))
    drawn = resample.drawn(weighted, "k", 0.02).collect()
    assert len(drawn) == 400
    assert np.mean([r.k % 2 == 0 for r in drawn]) == pytest.approx(0.75, abs=0.08)


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it should do to a small corpus, and their chain."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(6)) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    benchmark = [(1, prose(25)), (2, prose(25))]
    texts = [prose(100) + "\n" + prose(60) for _ in range(60)]
    bad = [prose(30) + " horrible " + prose(30) + " hideous" for _ in range(30)]
    run = prose(70)
    copies = [texts[0], texts[1].replace(" ", "  "), prose(20) + "\n" + run, prose(20) + "\n" + run, prose(20) + f" {benchmark[0][1]} " + prose(20)]
    odd = [None, "", " \n "]
    rows = list(enumerate(texts + bad + copies + odd))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(60 <= k < 90)) for k in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, str(tmp_path)), "t")
        left.append({r.doc_id: r.text for r in now.collect()})
        if len(left) < len(corpus_pipeline.STAGES):
            assert now.columns == docs.columns and now.schema.simpleString() == docs.schema.simpleString()
    toxic, lines, near, clean, last = left
    assert sum(60 <= k < 90 for k in toxic) <= 3 and sum(k < 60 for k in toxic) >= 57
    assert {95, 96, 97} <= set(last)
    assert 90 not in lines and (92 not in lines or run in lines[92]) and (93 not in lines or run not in lines[93])
    assert not {1, 91} <= set(near) and set(near) <= set(lines)
    assert 94 not in clean and set(near) - set(clean) <= {94}
    assert set(last) == set(clean)
    got = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == sorted(map(str, now.collect()))
