"""Source and sink queries: files are derived from the given tables, written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import compare as K
from assayer.operators import rollup as U
from assayer.plans import boards
from assayer.plans.registry import query
from assayer.plans.rollups import SCORES, scores
from assayer.session import TABLES, cut_lineage, fresh_path, table
from assayer.sources import answers as A
from assayer.sources import entries as E
from assayer.sources import files as X
from assayer.sources import sinks


def _turns(spark, sf):
    turn = F.col("turn")
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.concat_ws("_", "conv_id", "turn").alias("task_id"),
        F.when(turn % 2 == 0, "Scalar").otherwise("Rows").alias("answer_type"),
        F.when(turn % 3 == 0, "Set-Match").otherwise("Exact").alias("scoring_method"),
    )


def _write_lines(df, label):
    """One JSON document per line; ``df`` has the single column value (and partition columns)."""
    path = fresh_path(df.sparkSession, label)
    df.write.text(path)
    return path


def _task_documents(spark, sf):
    """A list for even conversations, an object with tasks for odd ones (a few turns each)."""
    truth = F.struct(
        F.concat(F.lit("gold_answers/"), "task_id", F.lit(".json")).alias("gold_answer_path"),
        F.col("answer_type").alias("gold_answer_type"),
        "scoring_method",
        F.col("turn").alias("expected_row_count"),
    )
    task = F.struct(
        "task_id",
        F.col("conv_id").cast("string").alias("session_id"),
        (F.col("conv_id") % 8 + 1).alias("tier"),
        F.array(F.struct((F.col("turn") + 1).alias("turn_number"), truth.alias("ground_truth"))).alias("turns"),
    )
    grouped = _turns(spark, sf).groupBy("conv_id").agg(F.collect_list(task).alias("tasks"))
    return grouped.select(
        F.when(F.col("conv_id") % 2 == 0, F.to_json("tasks"))
        .otherwise(F.to_json(F.struct("tasks")))
        .alias("value")
    )


@query(
    "load_tasks",
    """
    SELECT conv_id || '_' || turn AS task_id, conv_id::VARCHAR AS session_id, (conv_id % 8 + 1)::INT AS tier, (turn + 1)::INT AS turn_number,
           CASE WHEN turn % 2 = 0 THEN 'Scalar' ELSE 'Rows' END AS answer_type,
           CASE WHEN turn % 3 = 0 THEN 'Set-Match' ELSE 'Exact' END AS scoring_method, turn::BIGINT AS expected_row_count
    FROM conversations
    """,
)
def load_tasks(spark, sf):
    path = _write_lines(_task_documents(spark, sf), "tasks")
    return A.load_tasks(spark, path, lines=True).select(
        "task_id", "session_id", "tier", "turn_number", "answer_type", "scoring_method", "expected_row_count"
    )


def _nation_gold(spark, sf):
    """One artifact per nation: number of its customers."""
    counted = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    task = F.concat(F.lit("N"), "c_nationkey")
    doc = F.to_json(F.struct(task.alias("task_id"), F.col("n").alias("answer")))
    return counted.select(task.alias("task"), doc.alias("value"))


@query(
    "load_gold",
    "SELECT 'N' || c_nationkey AS task_id, count(*)::VARCHAR AS answer FROM customer GROUP BY c_nationkey",
)
def load_gold(spark, sf):
    gold = _nation_gold(spark, sf)
    path = fresh_path(spark, "gold")
    gold.write.partitionBy("task").text(path)
    tasks = gold.select(
        F.col("task").alias("task_id"),
        F.lit(None).cast("string").alias("gold_answer_sha256"),
        F.concat(F.lit("x/task="), "task", F.lit("/a.txt")).alias("gold_answer_path"),
    )
    loaded = A.load_gold(spark, path, tasks, name="task=([^/]+)/")
    head, _ = A.parse_answers(loaded, ["task_id"], ("answer",))
    return head.select("task_id", F.col("value.text").alias("answer"))


@query(
    "load_predictions",
    """
    SELECT r.run::VARCHAR AS run_id, conv_id || '_' || turn AS task_id, turn::VARCHAR AS answer, turn / 2 AS latency_seconds, turn % 3 = 0 AS sql_transpiled
    FROM conversations, (VALUES (0), (1)) r(run)
    """,
)
def load_predictions(spark, sf):
    """One document per conversation and run, written as lines of a folder per run."""
    p = F.struct(
        "task_id",
        F.col("turn").alias("predicted_answer"),
        (F.col("turn") / 2).alias("latency_seconds"),
        (F.col("turn") % 3 == 0).alias("sql_transpiled"),
    )
    docs = (
        _turns(spark, sf)
        .groupBy("conv_id")
        .agg(F.collect_list(p).alias("predictions"))
        .select(
            F.explode(F.array(F.lit(0), F.lit(1))).alias("run"),
            F.when(F.col("conv_id") % 2 == 0, F.to_json("predictions"))
            .otherwise(F.to_json(F.struct("predictions")))
            .alias("value"),
        )
    )
    path = fresh_path(spark, "predictions")
    docs.write.partitionBy("run").text(path)
    recs = A.load_predictions(spark, path, lines=True, run="run=([^/]+)/")
    recs = recs.withColumn("task_id", F.get_json_object("rec", "$.task_id"))
    head, _ = A.parse_answers(recs, ["run_id", "task_id"])
    fields = A.prediction_fields(recs).select("run_id", "task_id", "latency_seconds", "sql_transpiled")
    return head.join(fields, ["run_id", "task_id"]).select(
        "run_id", "task_id", F.col("value.text").alias("answer"), "latency_seconds", "sql_transpiled"
    )


@query(
    "prediction_problems",
    """
    WITH e AS (SELECT (user_id % 3)::VARCHAR AS run_id, CASE WHEN event_id % 97 <> 5 THEN event_id // 2 END AS t FROM events)
    SELECT run_id, NULL::VARCHAR AS task_id, 'missing_task_id' AS problem, count(*)::BIGINT AS n FROM e WHERE t IS NULL GROUP BY 1
    UNION ALL SELECT run_id, t::VARCHAR, 'duplicate_task_id', count(*)::BIGINT FROM e WHERE t IS NOT NULL GROUP BY ALL HAVING count(*) > 1
    """,
)
def prediction_problems(spark, sf):
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 3).cast("string").alias("run_id"),
        F.to_json(
            F.struct(F.when(F.col("event_id") % 97 != 5, F.expr("cast(event_id div 2 as string)")).alias("task_id"))
        ).alias("rec"),
    )
    return A.prediction_problems(e)


@query("load_entries", boards.ENTRIES + "SELECT entry_id, arm, CASE WHEN rate >= 0 THEN rate END AS pass_all, denominator::BIGINT AS denominator FROM e")
def load_entries(spark, sf):
    parts = F.struct("entry_id", "system", "model", "protocol", "results", "declarations")
    doc = F.to_json(parts, {"ignoreNullFields": "false"})
    path = _write_lines(boards.entries(spark, sf).select(doc.alias("value")), "entries")
    return E.load_entries(spark, path, lines=True).select(
        "entry_id",
        F.col("system.arm").alias("arm"),
        F.col("results.pass_all.mean").alias("pass_all"),
        F.col("protocol.denominator").alias("denominator"),
    )


STATEMENTS = {
    "q_count": "SELECT count(*) AS n FROM gold_customer WHERE c_acctbal > 0",
    "q_segments": "SELECT c_mktsegment, count(*) AS n FROM gold_customer GROUP BY c_mktsegment",
    "q_status": "SELECT o_orderstatus, max(o_totalprice) AS top FROM gold_orders GROUP BY o_orderstatus",
}


@query(
    "run_gold",
    """
    SELECT 'q_count' AS task_id, 'n=' || count(*) AS cells FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT 'q_segments', 'c_mktsegment=' || c_mktsegment || ',n=' || count(*) FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'q_status', 'o_orderstatus=' || o_orderstatus || ',top=' || max(o_totalprice) FROM orders GROUP BY o_orderstatus
    """,
)
def run_gold(spark, sf):
    for name in ("customer", "orders"):
        table(spark, sf, name).createOrReplaceTempView(f"gold_{name}")
    rows, _, _ = X.run_statements(spark, STATEMENTS)
    text = F.transform("cells", lambda c: F.concat_ws("=", c["name"], c["text"]))
    return rows.select("task_id", F.array_join(text, ",").alias("cells"))


@query(
    "certification",
    """
    WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
    o AS (SELECT o_orderstatus, max(o_totalprice) AS top FROM orders GROUP BY ALL)
    SELECT 'count' AS task_id, true AS passed, NULL AS error_type, 1::BIGINT AS predicted_row_count
    UNION ALL SELECT 'segments', true, NULL, count(*) FROM c
    UNION ALL SELECT 'tops', true, NULL, count(*) FROM o
    UNION ALL SELECT 'stale', false, NULL, count(*) FROM c
    UNION ALL SELECT unnest(['no_table', 'no_division', 'no_statement', 'no_scalar']), false, 'gold_sql_execution_error', NULL
    """,
)
def certification(spark, sf):
    """Statements of tasks against their gold answers: right ones, a stale one, and four that fail in their own ways."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    customer.createOrReplaceTempView("gold_customer")
    orders.createOrReplaceTempView("gold_orders")
    by_segment = "SELECT c_mktsegment, count(*) {} AS n FROM gold_customer GROUP BY c_mktsegment"
    rows = [
        ("count", "Scalar", STATEMENTS["q_count"]),
        ("segments", "Rows", by_segment.format("")),
        ("tops", "Rows", STATEMENTS["q_status"]),
        ("stale", "Rows", by_segment.format("+ 1")),
        ("no_table", "Rows", "SELECT * FROM gold_nowhere"),
        ("no_division", "Rows", "SELECT c_custkey / (c_custkey - c_custkey) AS x FROM gold_customer"),
        ("no_statement", "Rows", None),
        ("no_scalar", "Scalar", by_segment.format("")),
    ]
    tasks = spark.createDataFrame(rows, "task_id string, answer_type string, gold_sql string")
    tasks = tasks.withColumn("scoring_method", F.lit("Set-Match")).withColumn("value_tolerance", F.lit(None).cast("string"))
    segments = customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"))
    answers = {
        "count": customer.where("c_acctbal > 0").agg(F.count(F.lit(1)).alias("n")),
        "tops": orders.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("top")),
        **dict.fromkeys(["segments", "stale", "no_table", "no_division", "no_statement", "no_scalar"], segments),
    }
    gold = [K.answer_rows(df.withColumn("task_id", F.lit(t)), ["task_id"]) for t, df in answers.items()]
    gold = cut_lineage(reduce(DataFrame.unionByName, gold))
    scores = X.certify(spark, tasks, K.answer_heads(gold, tasks.select("task_id"), ["task_id"]), gold)
    return scores.select("task_id", "passed", "error_type", "predicted_row_count")


@query(
    "expand_sample",
    """
    SELECT conv_id || '_T' || turn AS task_id, CASE WHEN conv_id % 9 + 1 = 9 THEN conv_id::VARCHAR ELSE conv_id || '_T' || turn END AS session_id,
           CASE WHEN conv_id % 9 + 1 = 9 THEN 'multi_turn' ELSE 'single_turn' END AS interaction_mode,
           'gold_answers/' || conv_id || '_T' || turn || '.json' AS gold_answer_path, turn::BIGINT AS row_count, turn::VARCHAR AS answer
    FROM conversations
    """,
)
def expand_sample(spark, sf):
    q = F.struct(
        F.concat_ws("_T", "conv_id", "turn").alias("task_id"),
        (F.col("conv_id") % 9 + 1).alias("tier"),
        "answer_type",
        "scoring_method",
        F.struct(
            F.col("turn").alias("row_count"),
            F.array(F.lit("n")).alias("columns"),
            F.col("turn").alias("answer"),
        ).alias("gold"),
    )
    docs = (
        _turns(spark, sf)
        .groupBy("conv_id")
        .agg(F.collect_list(q).alias("questions"))
        .select(F.to_json(F.struct(F.lit("snap").alias("data_snapshot_id"), "questions")).alias("value"))
    )
    tasks, gold = A.expand_questions(spark, _write_lines(docs, "questions"), lines=True)
    head, _ = A.parse_answers(gold, ["task_id"], ("answer",))
    rows = gold.select("task_id", "row_count").join(head, "task_id")
    return tasks.join(rows, "task_id").select(
        "task_id", "session_id", "interaction_mode", "gold_answer_path", "row_count",
        F.col("value.text").alias("answer"),
    )


@query(
    "write_scores",
    SCORES
    + "SELECT run_id, count(*)::BIGINT AS rows_csv, count(*)::BIGINT AS rows_json, count(*) FILTER (WHERE passed)::BIGINT AS passed FROM s GROUP BY run_id",
)
def write_scores(spark, sf):
    out = fresh_path(spark, "scores")
    s = scores(spark, sf).withColumn("run_passes", F.array("passed"))
    sinks.write_scores(s, out)
    flat = spark.read.option("header", True).csv(f"{out}/task_scores_csv")
    full = spark.read.json(f"{out}/task_scores_json")
    a = flat.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(
        F.count(F.lit(1)).alias("rows_csv"), F.count_if(F.col("passed") == "true").alias("passed")
    )
    b = full.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count("run_passes").alias("rows_json"))
    return a.join(b, "run_id")


@query(
    "board_row",
    SCORES
    + """
    SELECT run_id, CASE WHEN run_id = '0' THEN 'gold-sql' ELSE 'submission' END AS mode, run_id = '0' AS is_certification,
           CASE WHEN run_id = '0' THEN 'certification' ELSE 'agent' END AS row_type, count(passed)::BIGINT AS tasks_total,
           count(*) FILTER (WHERE passed)::BIGINT AS tasks_passed, count(*) FILTER (WHERE passed) / count(passed) AS task_success_rate,
           count(*) FILTER (WHERE passed IS NULL)::BIGINT AS rubric_pending_count, round(avg(passed::INT), 8) AS macro_score,
           round(avg(row_f1) FILTER (WHERE passed IS NOT NULL), 8) AS avg_row_f1,
           round(avg(latency) FILTER (WHERE passed IS NOT NULL), 8) AS avg_latency_seconds,
           round(sum(cost) FILTER (WHERE passed IS NOT NULL), 8) AS total_cost_usd, '2026-01-15' AS scored_at_utc, 'v1' AS scorer_version
    FROM s GROUP BY run_id
    """,
)
def board_row(spark, sf):
    mode = F.when(F.col("run_id") == "0", "gold-sql").otherwise("submission")
    out = sinks.board_row(U.score_summary(scores(spark, sf)), mode, "v1", F.lit("2026-01-15"))
    return out.withColumns(
        {c: F.round(c, 8) for c in ("macro_score", "avg_row_f1", "avg_latency_seconds", "total_cost_usd")}
    )


@query(
    "multirun_board_row",
    SCORES
    + """
    SELECT 'set' AS run_id, 3 AS n_runs, count(*) FILTER (WHERE ok)::BIGINT AS tasks_total, count(*) FILTER (WHERE ok AND passes = 3)::BIGINT AS tasks_passed,
           round(avg(passes / 3) FILTER (WHERE ok), 8) AS task_success_rate, round(avg((passes > 0)::INT) FILTER (WHERE ok), 8) AS mean_any_pass,
           (SELECT string_agg(rate::DECIMAL(8,6)::VARCHAR, ',' ORDER BY run_id) FROM (SELECT run_id, round(avg(passed::INT), 6) AS rate FROM s WHERE passed IS NOT NULL GROUP BY 1)) AS per_run,
           round(avg(row_f1) FILTER (WHERE ok), 8) AS avg_row_f1
    FROM t
    """,
)
def multirun_board_row(spark, sf):
    s = scores(spark, sf)
    tasks = U.multirun_task(s, 3)
    means = tasks.agg(
        F.avg("row_f1").alias("avg_row_f1"),
        F.avg("latency_seconds").alias("avg_latency_seconds"),
        F.sum("cost_usd").alias("total_cost_usd"),
    )
    out = sinks.multirun_board_row(
        U.multirun_headline(tasks), means, U.per_run_rates(s), "set", 3, "v1", F.lit("2026-01-15")
    )
    per_run = F.array_join(
        F.transform("per_run_task_success_rate", lambda r: r.cast("decimal(8,6)").cast("string")), ","
    )
    return out.select(
        "run_id", "n_runs", "tasks_total", "tasks_passed",
        F.round("task_success_rate", 8).alias("task_success_rate"),
        F.round("mean_any_pass", 8).alias("mean_any_pass"),
        per_run.alias("per_run"),
        F.round("avg_row_f1", 8).alias("avg_row_f1"),
    )


DDL = """
CREATE TABLE region (r_regionkey INTEGER, r_name VARCHAR);
CREATE TABLE nation (n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER);
CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR);
CREATE TABLE supplier (s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE); -- one row per supplier
CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE);
CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR);
CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE,
    l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP);
CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR);
CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT);
CREATE TABLE embeddings (vec_id BIGINT, embedding ARRAY<FLOAT>, label INTEGER);
CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR);
CREATE TABLE benchmark (item_id BIGINT, text VARCHAR);
CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER);
CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR);
"""
#: Names of the declared columns of every table.
DECLARED = {t: X.declared_names(body) for t, body in X.declarations(DDL).items()}


@query(
    "warehouse_schema",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count({c})::BIGINT AS present FROM {t}" for t, columns in DECLARED.items() for c in columns
    ),
)
def warehouse_schema(spark, sf):
    """Every declared column, read with its declared type."""
    out = None
    for name, schema in X.schemas_from_ddl(DDL).items():
        df = X.read_table(spark, f"{sf}/{name}.parquet", schema)
        counts = df.agg(*[F.count(c).alias(c) for c in schema.names])
        part = counts.unpivot([], schema.names, "column", "present").withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# (table, column) -> what the delivered copy has in its place, for Spark and for the oracle
DELIVERED = {
    ("orders", "o_totalprice"): ("IF(o_orderkey % 97 = 5, o_totalprice + 0.01, o_totalprice)",) * 2,
    ("lineitem", "l_discount"): ("IF(l_orderkey % 3 = 0, 0.0D - l_discount + 2 * l_discount, l_discount)", "l_discount"),
    ("embeddings", "embedding"): (
        "IF(vec_id % 50 = 7, transform(embedding, (x, i) -> IF(i = 0, x + 1, x)), embedding)",
        "CASE WHEN vec_id % 50 = 7 THEN list_prepend(embedding[1] + 1, embedding[2:]) ELSE embedding END",
    ),
    ("events", "ts"): ("IF(event_id % 30 = 1, ts + INTERVAL 1 MICROSECOND, ts)", "CASE WHEN event_id % 30 = 1 THEN ts + INTERVAL 1 MICROSECOND ELSE ts END"),
    ("documents", "text"): ("IF(n_chars % 40 = 3, concat(text, ' '), text)", "CASE WHEN n_chars % 40 = 3 THEN text || ' ' ELSE text END"),
}


def _delivery_sql(name: str, columns: list[str]) -> str:
    same = lambda c: f"count(*) FILTER ({c} IS DISTINCT FROM ({DELIVERED.get((name, c), (c, c))[1]})) = 0"
    each = [f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", {same(c)} AS matches FROM {name}" for c in columns]
    return " UNION ALL ".join([*each, f"SELECT '{name}', '*', {' AND '.join(map(same, columns))} FROM {name}"])


@query("content_manifest", " UNION ALL ".join(_delivery_sql(t, columns) for t, columns in DECLARED.items()))
def content_manifest(spark, sf):
    """Every column of every table against a delivered copy, some of whose prices, vectors, times and texts were changed."""
    out = None
    for name in DECLARED:
        df = table(spark, sf, name)
        changed = {c: F.expr(x[0]) for (t, c), x in DELIVERED.items() if t == name}
        part = X.manifest_differences(X.content_manifest(df, name), X.content_manifest(df, name, changed))
        out = part if out is None else out.unionByName(part)
    return out


# table -> columns whose text is the same in both engines
CONTENT = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "supplier": "s_suppkey s_name s_nationkey",
    "customer": "c_custkey c_name c_nationkey c_mktsegment", "part": "p_partkey p_name p_brand p_type p_size",
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "events": "event_id user_id event_type props",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus",
    "documents": "doc_id text lang source n_chars", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
# column -> what the delivered copy has in its place
CHANGED = {
    "item_id": "CASE WHEN item_id % 7 = 3 THEN item_id + 1 ELSE item_id END",
    "event_type": "CASE WHEN event_id = 11 THEN 'other' ELSE event_type END",
}


def _fingerprint_sql(name: str, columns: str) -> str:
    def total(changed: dict) -> str:
        text = ", ".join(f"coalesce(({changed.get(c, c)})::VARCHAR, '~')" for c in columns.split())
        return f"coalesce(sum(('0x' || left(md5(concat_ws('|', {text})), 12))::BIGINT), 0)::VARCHAR"

    return (
        f"SELECT '{name}' AS \"table\", count(*)::BIGINT AS rows, {total({})} AS published, {total(CHANGED)} AS delivered, "
        f"{total({})} = {total(CHANGED)} AS matches FROM {name}"
    )


@query("file_fingerprint", " UNION ALL ".join(_fingerprint_sql(n, c) for n, c in CONTENT.items()))
def file_fingerprint(spark, sf):
    """Content of the tables against a delivered copy in which two of them were changed."""
    out = None
    for name, columns in CONTENT.items():
        kept = columns.split()
        row = table(spark, sf, name).agg(
            F.count(F.lit(1)).alias("rows"),
            X.content_fingerprint([F.col(c) for c in kept]).alias("published"),
            X.content_fingerprint([F.expr(CHANGED.get(c, c)) for c in kept]).alias("delivered"),
        ).select(F.lit(name).alias("table"), "*", (F.col("published") == F.col("delivered")).alias("matches"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "gold_hash_check",
    "SELECT conv_id || '_' || turn AS task_id FROM conversations WHERE turn % 5 = 2",
)
def gold_hash_check(spark, sf):
    """Artifacts whose recorded hash is not that of their answer: every fifth turn's is stale."""
    turn = F.col("turn").cast("string")
    answer = F.concat(F.lit('[{"a":'), turn, F.lit(',"b":1.5},{"a":null,"b":"é"}]'))
    loose = F.concat(F.lit('{"answer": [ {"b": 1.50, "a": '), turn, F.lit('}, {"b": "é", "a": null} ]}'))
    recorded = F.when(F.col("turn") % 5 == 2, F.sha2(F.concat(answer, F.lit(" ")), 256)).otherwise(
        F.sha2(answer, 256)
    )
    gold = _turns(spark, sf).select("task_id", loose.alias("rec"), recorded.alias("gold_answer_sha256"))
    return A.gold_hash_mismatches(gold).select("task_id")


@query(
    "tree_scan",
    "SELECT role, sum(length(text) + 1)::BIGINT AS characters FROM conversations GROUP BY role",
)
def tree_scan(spark, sf):
    path = fresh_path(spark, "tree")
    talk = table(spark, sf, "conversations").select("role", F.col("text").alias("value"))
    talk.write.option("maxRecordsPerFile", 1000).partitionBy("role").text(path)
    found = X.tree(spark, path, "*.txt")
    role = F.regexp_extract("doc", "role=([^/]+)/", 1)
    return found.groupBy(role.alias("role")).agg(F.sum(F.length("text")).cast("long").alias("characters"))
