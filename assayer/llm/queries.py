"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from assayer.llm import bpe, decontaminate, fingerprint, jaccard, lexical, lineruns, merkle, mixing, pii, resample, secrets, toxicity, warczip
from assayer.plans.registry import query
from assayer.session import fresh_path, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op8_secret_scan")
def op8_secret_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return secrets.scan(docs).drop("text")


@query("op9_bpe")
def op9_bpe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, VOCABULARY).drop("text")


@query("op10_fingerprint")
def op10_fingerprint(spark, sf):
    return fingerprint.fingerprints(table(spark, sf, "documents"))


@query(
    "op5_warc_zip",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
           CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
    FROM d
    """,
)
def op5_warc_zip(spark, sf):
    path = fresh_path(spark, "packages")
    warczip.write_packages(warczip.with_types(table(spark, sf, "pages")), path)
    found = warczip.read_packages(spark, path, payload=False)
    return found.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op7_resample")
def op7_resample(spark, sf):
    """Rows of the documents drawn; labels of every fifth document are left for judging the result."""
    labels = table(spark, sf, "labels").where("crc32(cast(doc_id as string)) % 5 != 0")
    return resample.resample(table(spark, sf, "documents"), labels)


@query("op4_decontaminate")
def op4_decontaminate(spark, sf):
    return decontaminate.find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op2_line_runs",
    r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS q FROM documents),
    s AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY q) AS p,
               sum(w) OVER (PARTITION BY doc_id ORDER BY q) AS c
        FROM (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM l) WHERE w > 0),
    win AS (
        SELECT a.doc_id, a.p AS a, min(b.p) AS e FROM s a JOIN s b
        ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.c - a.c + a.w >= 50 GROUP BY ALL
        UNION
        SELECT b.doc_id, max(a.p) AS a, b.p AS e FROM s a JOIN s b
        ON a.doc_id = b.doc_id AND a.p BETWEEN b.p - 49 AND b.p AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.p),
    named AS (
        SELECT win.doc_id, a, e, string_agg(x, chr(10) ORDER BY p) AS body FROM win JOIN s
        ON win.doc_id = s.doc_id AND p BETWEEN a AND e GROUP BY ALL),
    later AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS copy FROM named),
    gone AS (
        SELECT DISTINCT s.doc_id, s.q FROM later JOIN s ON later.doc_id = s.doc_id AND s.p BETWEEN a AND e
        WHERE copy > 1),
    kept AS (
        SELECT l.doc_id, count(gone.q) AS n, string_agg(l.q::VARCHAR, ',' ORDER BY l.q) FILTER (WHERE gone.q IS NOT NULL) AS g,
               string_agg(x, chr(10) ORDER BY l.q) FILTER (WHERE gone.q IS NULL) AS body
        FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.q = gone.q GROUP BY l.doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_deleted, coalesce(g, '') AS deleted_lines,
           sha256(coalesce(body, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
)
def op2_line_runs(spark, sf):
    docs = lineruns.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.array_join("gone_lines", ","), F.lit("")).alias("deleted_lines"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


@query(
    "op3_ngram_jaccard",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
    reach AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION
        SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
    SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
    FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
)
def op3_ngram_jaccard(spark, sf):
    return jaccard.joined(table(spark, sf, "documents"), size=3, num=90, den=100).drop("_th")


@query("op6_toxicity")
def op6_toxicity(spark, sf):
    """Learned from labels whose key's checksum leaves a remainder; the others are held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf, "labels").where(~held_out)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.scored(docs, labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op1_pii_boosting")
def op1_pii_boosting(spark, sf):
    return pii.scan(table(spark, sf, "documents"))


@query(
    "op11_merkle",
    """
    WITH RECURSIVE c AS (
        SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
        FROM documents),
    f AS (
        SELECT doc_id, lang, crc % 7 = 0 AS tampered,
               coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') AS a,
               n_chars, coalesce(strlen(text) || ':' || text, '-') AS b FROM c),
    leaves AS (
        SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
               sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS h,
               sha256(a || coalesce(strlen((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT), '-') || b) AS t
        FROM f),
    inner_levels AS (
        SELECT lang, 0 AS level, i, n AS m, h FROM leaves
        UNION ALL
        SELECT lang, level + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM inner_levels
        WHERE m > 1 GROUP BY lang, level, i // 2, m),
    subroots AS (
        SELECT lang, level, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM inner_levels WHERE m = 1),
    outer_levels AS (
        SELECT 0 AS level, g AS i, n AS m, h FROM subroots
        UNION ALL
        SELECT level + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM outer_levels WHERE m > 1 GROUP BY level, i // 2, m),
    proofs AS (
        SELECT l.doc_id, s.lang, x.level AS level, x.h, x.i AS place FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
        JOIN inner_levels x ON x.lang IS NOT DISTINCT FROM l.lang AND x.level < s.level AND x.i = xor(l.i >> x.level::BIGINT, 1)
        UNION ALL
        SELECT l.doc_id, s.lang, s.level + x.level, x.h, x.i FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
        JOIN outer_levels x ON x.m > 1 AND x.i = xor(s.g >> x.level::BIGINT, 1)),
    proof AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY level)) AS p FROM proofs GROUP BY doc_id),
    tall AS (SELECT max(level) AS up FROM outer_levels),
    folds AS (
        SELECT l.doc_id, 0 AS step, s.level + (SELECT up FROM tall) AS height, l.t AS h FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
        UNION ALL
        SELECT f.doc_id, step + 1, height, CASE WHEN p.h IS NULL THEN sha256(f.h) WHEN p.place % 2 = 0 THEN sha256(p.h || f.h) ELSE sha256(f.h || p.h) END
        FROM folds f LEFT JOIN proofs p ON p.doc_id = f.doc_id AND p.level = f.step WHERE step < height)
    SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, f.h AS folded_root,
           f.h = r.h AS verified
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN outer_levels r ON r.m = 1
    JOIN folds f ON f.doc_id = l.doc_id AND f.step = f.height LEFT JOIN proof p ON p.doc_id = l.doc_id
    """,
)
def op11_merkle(spark, sf):
    """Where seven divides the key's checksum, the tampered row has one character more."""
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    tampered = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + more}
    return merkle.manifest(table(spark, sf, "documents"), tampered=tampered)


@query(
    "op12_mix",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    s AS (
        SELECT source, sum(size)::HUGEINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
        FROM d GROUP BY source),
    rounds AS (
        SELECT 0 AS i, source, s, w, FALSE AS stopped, sum(s) OVER () AS rest, sum(w) OVER () AS sharing FROM s
        UNION ALL
        SELECT i + 1, source, s, w, stopped,
               sum(s) OVER () - 3 * coalesce(sum(s) FILTER (WHERE stopped) OVER (), 0),
               coalesce(sum(w) FILTER (WHERE NOT stopped) OVER (), 0)
        FROM (SELECT * REPLACE (stopped OR 3 * s * sharing < rest * w AS stopped) FROM rounds)
        WHERE i < (SELECT count(*) FROM s)),
    aims AS (
        SELECT source, s, CASE WHEN stopped THEN (3 * s)::DOUBLE ELSE (rest * w)::DOUBLE / sharing::DOUBLE END AS target,
               CASE WHEN stopped THEN 3 * s ELSE rest * w // sharing END AS words
        FROM rounds WHERE i = (SELECT count(*) FROM s)),
    o AS (
        SELECT d.doc_id, d.size, a.s, a.target, a.words, CASE WHEN a.s > 0 THEN a.words // a.s ELSE 0 END AS copies,
               sum(d.size) OVER (PARTITION BY d.source ORDER BY sha256('20240:' || d.doc_id), d.doc_id, d.size
                                 ROWS UNBOUNDED PRECEDING) - d.size AS before
        FROM d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source)
    SELECT doc_id, size, s::BIGINT AS source_size, target,
           (copies * size + greatest(least(words - copies * s - before, size), 0))::BIGINT AS taken
    FROM o
    """,
)
def op12_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op13_search",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    totals AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
    tf AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY doc_id, len(w), t),
    q AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    w AS (
        SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM tf, totals WHERE t IN (SELECT t FROM q) GROUP BY t),
    s AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
        FROM q JOIN w USING (t) JOIN tf USING (t), totals GROUP BY item_id, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 50
    """,
)
def op13_search(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
