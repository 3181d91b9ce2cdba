"""Leak-scan queries over documents, pages and the held-out benchmark passages.

Documents get file-like paths and every document mentions ids derived from its number; the parts
play the published ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import leak as L
from assayer.plans.registry import query
from assayer.session import table

IGNORE = ("scratch/", "*.log", "tmp_?.md")
EXEMPT = ("lang/en/doc_10.md", "lang/fr/doc_12.json")


def _id(number):
    """Task id of a number: tier, three-digit serial, first turn."""
    return F.concat(
        F.lit("CB_T"), (number % 8 + 1).cast("string"), F.lit("_"), F.lpad(number.cast("string"), 3, "0"), F.lit("_T1")
    )


def _published(spark, sf):
    return table(spark, sf, "part").where("p_size <= 25").select(_id(F.col("p_partkey")).alias("id"))


def _files(spark, sf):
    """Documents as files; each text ends with ids of its own number and two neighbours."""
    k = F.col("doc_id")
    suffix = F.when(k % 3 == 0, ".json").when(k % 3 == 1, ".md").otherwise(".bin")
    folder = (
        F.when(k % 17 == 4, F.lit("data/gold_answers/"))
        .when(k % 17 == 5, F.lit("scratch/answer_key/"))
        .otherwise(F.concat(F.lit("lang/"), "lang", F.lit("/")))
    )
    name = (
        F.when(k % 19 == 6, F.concat(F.lit("run_"), k, F.lit("_submission.json")))
        .when(k % 19 == 7, F.concat(F.lit("run_"), k, F.lit(".log")))
        .otherwise(F.concat(F.lit("doc_"), k, suffix))
    )
    tail = F.concat_ws(
        " ",
        F.lit("\nSee"),
        _id(k),
        _id(k + 1),
        F.when(k % 10 == 0, F.concat(_id(k), F.lit("_T1"))),
        F.when(k % 10 == 3, F.substring_index(_id(k), "_T1", 1)),
        F.when(k % 10 == 7, F.array_join(F.transform(F.sequence(F.lit(2), F.lit(8)), lambda i: _id(k + i)), " ")),
        F.when(k % 10 == 9, F.lit('{"gold_sql" : 1}')),
    )
    return table(spark, sf, "documents").select(
        F.concat(folder, name).alias("doc"), F.concat("text", tail).alias("text"), k.alias("k")
    )


def _sql_id(x: str) -> str:
    return f"'CB_T' || (({x}) % 8 + 1) || '_' || CASE WHEN ({x}) < 1000 THEN lpad(({x})::VARCHAR, 3, '0') ELSE substr(({x})::VARCHAR, 1, 3) END || '_T1'"


FILES = f"""
WITH f AS (
    SELECT doc_id AS k,
           CASE WHEN doc_id % 17 = 4 THEN 'data/gold_answers/' WHEN doc_id % 17 = 5 THEN 'scratch/answer_key/' ELSE 'lang/' || lang || '/' END
           || CASE WHEN doc_id % 19 = 6 THEN 'run_' || doc_id || '_submission.json' WHEN doc_id % 19 = 7 THEN 'run_' || doc_id || '.log'
                   ELSE 'doc_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.md' ELSE '.bin' END END AS doc,
           list_distinct(list_filter([{_sql_id('doc_id')}, {_sql_id('doc_id + 1')},
               CASE WHEN doc_id % 10 = 0 THEN {_sql_id('doc_id')} || '_T1' END,
               CASE WHEN doc_id % 10 = 3 THEN regexp_replace({_sql_id('doc_id')}, '_T1$', '') END,
               {', '.join(f"CASE WHEN doc_id % 10 = 7 THEN {_sql_id(f'doc_id + {i}')} END" for i in range(2, 9))}], lambda x: x IS NOT NULL)) AS ids
    FROM documents),
p AS (SELECT DISTINCT {_sql_id('p_partkey')} AS id FROM part WHERE p_size <= 25),
a AS (SELECT id FROM p UNION SELECT regexp_replace(id, '_T1$', '') FROM p UNION SELECT id || '_T1' FROM p),
i AS (SELECT k, doc, unnest(ids) AS id FROM f),
u AS (SELECT k, doc, id FROM i WHERE id NOT IN (SELECT id FROM a)),
n AS (SELECT doc, count(*) AS n, list_sort(list(id)) AS l FROM u GROUP BY doc)
"""
SHOWN = "array_to_string(l[1:5], ', ') || CASE WHEN n > 5 THEN ' …' ELSE '' END"


@query("expand_allowlist", FILES + "SELECT id FROM a")
def expand_allowlist(spark, sf):
    return L.expand_allowlist(_published(spark, sf))


@query("extract_ids", FILES + "SELECT doc, id FROM i")
def extract_ids(spark, sf):
    return L.extract_ids(_files(spark, sf))


@query("unknown_ids", FILES + f"SELECT doc, n::BIGINT AS n, {SHOWN} AS shown FROM n")
def unknown_ids(spark, sf):
    return L.unknown_ids(_files(spark, sf), L.expand_allowlist(_published(spark, sf)))


@query(
    "first_k_shown",
    """
    SELECT o_orderpriority, count(DISTINCT o_custkey)::BIGINT AS n,
           array_to_string((list_sort(list(DISTINCT o_custkey)))[1:5], ', ') AS shown FROM orders GROUP BY 1
    """,
)
def first_k_shown(spark, sf):
    out = L.first_k(table(spark, sf, "orders"), "o_orderpriority", "o_custkey", 5)
    text = F.array_join(F.transform("shown", lambda x: x.cast("string")), ", ")
    return out.select("o_orderpriority", "n", text.alias("shown"))


@query(
    "forbidden_path",
    FILES
    + "SELECT doc, d.part AS detail FROM f, (VALUES ('gold_answers'), ('answer_key')) d(part) WHERE contains(doc, d.part)",
)
def forbidden_path(spark, sf):
    return L.forbidden_path(_files(spark, sf))


@query("forbidden_name", FILES + "SELECT doc FROM f WHERE k % 19 = 6")
def forbidden_name(spark, sf):
    return L.forbidden_name(_files(spark, sf), EXEMPT).select("doc")


@query(
    "sensitive_field",
    FILES + f"SELECT doc, 'gold_sql' AS detail FROM f WHERE k % 10 = 9 AND doc NOT IN {EXEMPT}",
)
def sensitive_field(spark, sf):
    return L.sensitive_field(_files(spark, sf), EXEMPT)


IGNORED = "(doc LIKE 'scratch/%' OR doc LIKE '%.log')"


@query(
    "ignore_filter",
    FILES
    + f"SELECT count(*) FILTER (WHERE NOT {IGNORED})::BIGINT AS scanned, count(*) FILTER (WHERE {IGNORED})::BIGINT AS skipped FROM f",
)
def ignore_filter(spark, sf):
    return L.skipped(_files(spark, sf), IGNORE)


@query(
    "allowlist_required",
    "SELECT 'allowlist_required' AS rule, count(*)::BIGINT AS n FROM (SELECT 1 FROM part WHERE p_size > 9999 HAVING count(*) = 0)",
)
def allowlist_required(spark, sf):
    """A scan against an empty allowlist reports that, whatever else it finds."""
    nothing = table(spark, sf, "part").where("p_size > 9999").select(_id(F.col("p_partkey")).alias("id"))
    found = L.scan(_files(spark, sf), nothing, IGNORE)
    return (
        found.where("rule = 'allowlist_required'").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "leak_scan",
    FILES
    + f""",
    k AS (SELECT * FROM f WHERE NOT {IGNORED}),
    t AS (SELECT * FROM k WHERE doc NOT LIKE '%.bin')
    SELECT doc, 'forbidden_path' AS rule, 'gold_answers' AS detail FROM k WHERE contains(doc, 'gold_answers')
    UNION ALL SELECT doc, 'forbidden_name', 'run_' || k || '_submission.json' FROM k WHERE k % 19 = 6
    UNION ALL SELECT doc, 'sensitive_field', 'gold_sql' FROM t WHERE k % 10 = 9 AND doc NOT IN {EXEMPT}
    UNION ALL SELECT doc, 'unknown_ids', n || ' unknown: ' || {SHOWN} FROM n WHERE doc IN (SELECT doc FROM t)
    """,
)
def leak_scan(spark, sf):
    return L.scan(_files(spark, sf).drop("k"), _published(spark, sf), IGNORE, EXEMPT)


@query(
    "verbatim_passage",
    "SELECT doc_id AS doc, item_id AS item FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
def verbatim_passage(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), "text")
    return L.verbatim_passages(docs, items)


@query(
    "verbatim_in_pages",
    "SELECT page_id AS doc, item_id AS item FROM pages p JOIN benchmark b ON contains(p.html, b.text)",
)
def verbatim_in_pages(spark, sf):
    docs = table(spark, sf, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), "text")
    return L.verbatim_passages(docs, items)
