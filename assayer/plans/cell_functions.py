"""Cell normalisation, numbers, text and calendar expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import calendar as cal
from assayer.functions import cells as C
from assayer.operators import compare as K
from assayer.operators import grade, relax
from assayer.plans.registry import query
from assayer.session import table
from assayer.sources import answers as A


@query(
    "null_like",
    """
    SELECT l_linenumber,
           count(*) FILTER (WHERE l_linenumber <= 3)::BIGINT AS missing,
           count(*)::BIGINT AS n
    FROM lineitem GROUP BY l_linenumber
    """,
)
def null_like(spark, sf):
    value = (
        F.when(F.col("l_linenumber") == 1, F.lit(float("nan")))
        .when(F.col("l_linenumber") == 2, F.lit(float("inf")))
        .when(F.col("l_linenumber") > 3, F.col("l_quantity"))
    )
    return (
        table(spark, sf, "lineitem")
        .select("l_linenumber", C.null_like(value, T.DoubleType()).alias("gone"))
        .groupBy("l_linenumber")
        .agg(F.count_if("gone").alias("missing"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "normalize_cell",
    """
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS moment,
           o_totalprice::VARCHAR AS amount, o_orderpriority AS label,
           (o_orderstatus = 'F')::VARCHAR AS flag
    FROM orders
    UNION ALL
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
             || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END,
           value::VARCHAR, event_type, (user_id % 2 = 0)::VARCHAR
    FROM events
    """,
)
def normalize_cell(spark, sf):
    def texts(df):
        return df.select(
            "id",
            *[
                C.cell_text(F.col(c), df.schema[c].dataType)[1].alias(c)
                for c in ("moment", "amount", "label", "flag")
            ],
        )

    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("moment"),
        F.col("o_totalprice").alias("amount"),
        F.encode("o_orderpriority", "UTF-8").alias("label"),
        (F.col("o_orderstatus") == "F").alias("flag"),
    )
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("moment"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("label"),
        (F.col("user_id") % 2 == 0).alias("flag"),
    )
    return texts(orders).unionByName(texts(events))


@query(
    "normalize_text",
    r"""
    SELECT doc_id AS id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS digest
    FROM documents
    UNION ALL
    SELECT conv_id * 1000 + turn,
           md5(trim(regexp_replace(nfc_normalize('"' || text || '" - '), '\s+', ' ', 'g')))
    FROM conversations
    """,
)
def normalize_text(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.replace("text", F.lit(" "), F.lit("  ")).alias("text")
    )
    talk = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat(F.lit("“"), "text", F.lit("”\t— ")).alias("text"),
    )
    clean = docs.unionByName(talk).select("id", C.normalize_text(F.col("text")).alias("text"))
    return clean.select("id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(
    "midnight_to_date",
    """
    SELECT o_orderkey, CASE o_orderkey % 4
        WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.001'
        ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00' END AS moment
    FROM orders
    """,
)
def midnight_to_date(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(day, F.lit("T00:00:00")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(day, F.lit(" 00:00:00.000")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(day, F.lit("T00:00:00.001")))
        .otherwise(F.concat(day, F.lit(" 10:00:00")))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", C.midnight_to_date(text).alias("moment")
    )


@query(
    "canonical_json",
    """
    SELECT '{"c_acctbal":' || CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE c_acctbal::VARCHAR END
        || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment
        || '","c_name":"' || c_name || '"}' AS row_json
    FROM customer
    """,
)
def canonical_json(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_name",
        "c_mktsegment",
        F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan")))
        .otherwise(F.col("c_acctbal"))
        .alias("c_acctbal"),
        "c_custkey",
    )
    return rows.select(C.canonical_json(rows, rows.columns).alias("row_json"))


@query(
    "try_number",
    """
    SELECT l_linenumber, count(*)::BIGINT AS n,
           count(*) FILTER (WHERE l_linenumber NOT IN (3, 6))::BIGINT AS numbers,
           sum(CASE WHEN l_linenumber IN (3, 6) THEN 0
                    WHEN l_linenumber = 2 THEN l_quantity::DECIMAL(18,2) * 1000
                    ELSE l_quantity::DECIMAL(18,2) END)::DOUBLE AS total
    FROM lineitem GROUP BY l_linenumber
    """,
)
def try_number(spark, sf):
    plain = F.col("l_quantity").cast("string")
    line = F.col("l_linenumber")
    text = (
        F.when(line == 2, F.concat(plain, F.lit("e3")))
        .when(line == 3, F.concat(plain, F.lit(" units")))
        .when(line == 4, F.concat(F.lit("  +"), plain, F.lit(" ")))
        .when(line == 5, F.concat(plain, F.lit("0_00")))
        .otherwise(plain)
    )
    kind = F.when(line == 6, "bool").when(line == 1, "num").otherwise("str")
    number = table(spark, sf, "lineitem").select(
        "l_linenumber", C.try_number(kind, text).alias("x")
    )
    return number.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("x").alias("numbers"),
        F.coalesce(F.sum(F.col("x").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("total"),
    )


@query(
    "decimal_places",
    """
    SELECT length(split_part(l_extendedprice::VARCHAR, '.', 2))::BIGINT AS places,
           count(*)::BIGINT AS n
    FROM lineitem GROUP BY 1
    """,
)
def decimal_places(spark, sf):
    places = C.decimal_places(C.float_text(F.col("l_extendedprice")))
    return (
        table(spark, sf, "lineitem")
        .select(places.cast("long").alias("places"))
        .groupBy("places")
        .agg(F.count(F.lit(1)).alias("n"))
    )


NET = "l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2))"


def _net_pairs(spark, sf):
    """Rounded amount next to its unrounded value, shifted by a cent on every third line."""
    net = F.col("l_extendedprice").cast("decimal(14,2)") * (
        F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    )
    shift = F.when(F.col("l_linenumber") == 3, F.lit("0.01")).otherwise("0").cast("decimal(4,2)")
    return table(spark, sf, "lineitem").select(
        "l_linenumber",
        F.bround(net, 2).cast("double").alias("gold"),
        (net + shift).cast("double").alias("pred"),
    )


@query(
    "numeric_equal",
    f"""
    WITH p AS (
        SELECT l_linenumber, round_even({NET}, 2) AS g,
               {NET} + CASE WHEN l_linenumber = 3 THEN 0.01 ELSE 0 END AS p
        FROM lineitem),
    q AS (SELECT *, g = round_even(g, 1) AS short FROM p)
    SELECT l_linenumber, count(*)::BIGINT AS n,
           count(*) FILTER (WHERE g = CASE WHEN short THEN round_even(p, 1)
                                           ELSE round_even(p, 2) END)::BIGINT AS equal
    FROM q GROUP BY l_linenumber
    """,
)
def numeric_equal(spark, sf):
    df = _net_pairs(spark, sf)
    df, _, prepared = C.prepared_columns(df, ["gold", "pred"])
    pair = df.select("l_linenumber", prepared.alias("v"))
    same = C.numeric_equal(F.col("v")[0], F.col("v")[1], F.lit(C.ABS_TOL), F.lit(C.REL_TOL))
    return (
        pair.select("l_linenumber", same.alias("same"))
        .groupBy("l_linenumber")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("equal"))
    )


@query(
    "values_equal",
    """
    SELECT c_custkey % 8 AS kind, count(*)::BIGINT AS n,
           count(*) FILTER (WHERE c_custkey % 8 NOT IN (3, 5))::BIGINT AS equal
    FROM customer GROUP BY 1
    """,
)
def values_equal(spark, sf):
    k = F.col("c_custkey") % 8
    raw = table(spark, sf, "customer").select(k.alias("kind"), "c_mktsegment", "c_acctbal")
    money = C.float_text(F.col("c_acctbal"))
    k = F.col("kind")
    gold_kind = (
        F.when(k.isin(0, 3), "str").when(k.isin(1, 2, 5), "num").when(k == 4, "null").when(k == 6, "bool")
    ).otherwise("num")
    pred_kind = (
        F.when(k.isin(0, 1, 3), "str").when(k.isin(2, 6), "num").when(k.isin(4, 5), "null")
    ).otherwise("num")
    gold = F.when(k.isin(0, 3), F.col("c_mktsegment")).when(k == 6, "true").when(k != 4, money)
    pred = (
        F.when(k == 0, F.lower(F.concat(F.lit(" "), "c_mktsegment")))
        .when(k == 3, F.concat("c_mktsegment", F.lit("x")))
        .when(k == 1, F.concat(money, F.lit("000")))
        .when(k == 6, "1.0")
        .when(k == 7, C.float_text(F.col("c_acctbal") + 1e-7))
        .when(k == 2, money)
    )
    pairs = raw.select(
        "kind",
        C.prepare(
            F.array(
                F.struct(F.lit("g").alias("name"), gold_kind.alias("kind"), gold.alias("text")),
                F.struct(F.lit("p").alias("name"), pred_kind.alias("kind"), pred.alias("text")),
            )
        ).alias("v"),
    )
    same = C.values_equal(F.col("v")[0], F.col("v")[1], F.lit(C.ABS_TOL), F.lit(C.REL_TOL))
    return (
        pairs.select("kind", same.alias("same"))
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("equal"))
    )


@query(
    "cell_token",
    """
    SELECT 'num:' || rtrim(p_retailprice::DECIMAL(18,2)::VARCHAR, '0') AS price,
           'str:' || lower(p_type) AS kind, 'bool:' || (p_size > 25)::VARCHAR AS large,
           'num:' || p_size || '.' AS size, count(*)::BIGINT AS n
    FROM part GROUP BY ALL
    """,
)
def cell_token(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_retailprice").alias("price"),
        F.concat(F.lit(" "), "p_type").alias("kind"),
        (F.col("p_size") > 25).alias("large"),
        F.col("p_size").alias("size"),
    )
    tokens = part.select(C.cells_of(part, part.columns).alias("c")).select(
        F.transform("c", C.cell_token).alias("t")
    )
    named = [F.col("t")[i].alias(c) for i, c in enumerate(part.columns)]
    return tokens.select(*named).groupBy(*part.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "row_signature",
    """
    SELECT '["num:' || CASE c_nationkey WHEN 0 THEN '' ELSE c_nationkey::VARCHAR END || '.","str:' || lower(c_mktsegment) || '"]' AS sig,
           (2 * count(*))::BIGINT AS n
    FROM customer GROUP BY 1
    """,
)
def row_signature(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    swapped = c.select(F.upper("c_mktsegment").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    rows = K.answer_rows(c, []).unionByName(K.answer_rows(swapped, []))
    return K.signed(rows).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))


@query(
    "column_signature",
    """
    WITH g AS (
        SELECT 's_suppkey' AS c, s_suppkey::DOUBLE AS v FROM supplier
        UNION ALL SELECT 's_nationkey', s_nationkey::DOUBLE FROM supplier
        UNION ALL SELECT 's_acctbal', s_acctbal FROM supplier),
    p AS (
        SELECT 'a' AS c, s_acctbal AS v FROM supplier
        UNION ALL SELECT 'b', s_suppkey::DOUBLE FROM supplier
        UNION ALL SELECT 'c', s_nationkey::DOUBLE FROM supplier
        UNION ALL SELECT 'd', (s_nationkey + 1)::DOUBLE FROM supplier),
    gh AS (SELECT c, md5(string_agg(v::VARCHAR, ',' ORDER BY v)) AS h FROM g GROUP BY c),
    ph AS (SELECT c, md5(string_agg(v::VARCHAR, ',' ORDER BY v)) AS h FROM p GROUP BY c)
    SELECT gh.c AS gold_col, ph.c AS pred_col FROM gh JOIN ph USING (h)
    """,
)
def column_signature(spark, sf):
    s = table(spark, sf, "supplier").withColumn("task_id", F.lit("t")).withColumn("run_id", F.lit("0"))
    gold = K.answer_rows(s.select("task_id", "s_suppkey", "s_nationkey", "s_acctbal"), ["task_id"])
    pred = K.answer_rows(
        s.select(
            "run_id",
            "task_id",
            F.col("s_acctbal").alias("a"),
            F.col("s_suppkey").cast("double").alias("b"),
            F.col("s_nationkey").alias("c"),
            (F.col("s_nationkey") + 1).alias("d"),
        ),
        ["run_id", "task_id"],
    )
    pairs = s.select("run_id", "task_id").distinct()
    return relax.column_candidates(gold, pred, pairs).select("gold_col", "pred_col")


def _json_answers(spark, sf):
    """One JSON answer per conversation turn; its shape depends on the turn."""
    turn = F.col("turn").cast("string")
    k = F.col("turn") % 8
    answer = (
        F.when(k == 0, F.concat(F.lit('"predicted_answer":'), turn))
        .when(k == 1, F.concat(F.lit('"predicted_answer":{"c":'), turn, F.lit("}")))
        .when(k == 2, F.concat(F.lit('"predicted_answer":[{"c":'), turn, F.lit("}]")))
        .when(k == 3, F.concat(F.lit('"answer":['), turn, F.lit(',"x"]')))
        .when(k == 4, F.lit('"predicted_answer":[]'))
        .when(k == 5, F.lit('"predicted_answer":null'))
        .when(k == 6, F.concat(F.lit('"answer":{"rows":[{"a":'), turn, F.lit(',"b":1.50},{"a":2}]}')))
        .otherwise(F.lit('"note":"none"'))
    )
    return table(spark, sf, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("task_id"),
        F.concat(F.lit("{"), answer, F.lit("}")).alias("rec"),
    )


@query(
    "coerce_answer",
    """
    SELECT conv_id || '_' || turn AS task_id,
           CASE turn % 8 WHEN 0 THEN 'scalar' WHEN 1 THEN 'dict' WHEN 2 THEN 'list' WHEN 3 THEN 'list'
               WHEN 4 THEN 'list' WHEN 5 THEN 'null' WHEN 6 THEN 'dict' ELSE 'missing_answer' END AS raw,
           CASE WHEN turn % 8 IN (1, 2, 3, 4, 6) THEN 'list' ELSE 'value' END AS shape,
           (CASE turn % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 2 ELSE 0 END)::BIGINT AS n_rows,
           CASE turn % 8 WHEN 0 THEN 'value' WHEN 1 THEN 'c' WHEN 2 THEN 'c' WHEN 3 THEN 'value'
               WHEN 4 THEN '' WHEN 6 THEN 'a,b' ELSE 'value' END AS columns,
           CASE WHEN turn % 8 IN (0, 1, 2) THEN turn::VARCHAR END AS value
    FROM conversations
    """,
)
def coerce_answer(spark, sf):
    head, _ = A.parse_answers(_json_answers(spark, sf), ["task_id"])
    return head.select(
        "task_id",
        "raw",
        "shape",
        "n_rows",
        F.array_join("columns", ",").alias("columns"),
        F.when(F.col("value.kind") == "num", F.col("value.text")).alias("value"),
    )


@query(
    "rows_and_columns",
    """
    WITH t AS (SELECT conv_id || '_' || turn AS task_id, turn, turn % 8 AS k FROM conversations)
    SELECT task_id, 0::BIGINT AS row_pos, CASE WHEN k IN (1, 2) THEN 'c' ELSE 'value' END || '=' || turn AS cells
    FROM t WHERE k < 4
    UNION ALL SELECT task_id, 1, 'value=x' FROM t WHERE k = 3
    UNION ALL SELECT task_id, 0, 'a=' || turn || ',b=1.5' FROM t WHERE k = 6
    UNION ALL SELECT task_id, 1, 'a=2' FROM t WHERE k = 6
    """,
)
def rows_and_columns(spark, sf):
    _, rows = A.parse_answers(_json_answers(spark, sf), ["task_id"])
    text = F.transform("cells", lambda c: F.concat_ws("=", c["name"], c["text"]))
    return rows.select("task_id", "row_pos", F.array_join(text, ",").alias("cells"))


@query(
    "frame_to_answer",
    """
    SELECT '["' || n_name || '",' || count(*) || ']' AS row_json,
           (row_number() OVER (ORDER BY n_name))::BIGINT AS row_pos
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
    """,
)
def frame_to_answer(spark, sf):
    """A result frame as answer rows in canonical order."""
    from assayer.operators.ordering import numbered

    result = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count(F.lit(1)).alias("z_clients"))
    )
    keyed = result.withColumn("_key", C.canonical_json(result, result.columns))
    placed = numbered(keyed, [], ["_key"])
    rows = K.answer_rows(placed.drop("_key"), [], order="row_pos")
    cell = F.transform(
        "cells",
        lambda c: F.when(c["kind"] == "num", c["text"]).otherwise(
            F.concat(F.lit('"'), c["text"], F.lit('"'))
        ),
    )
    return rows.select(
        F.concat(F.lit("["), F.array_join(cell, ","), F.lit("]")).alias("row_json"), "row_pos"
    )


@query(
    "canonical_sort",
    """
    SELECT s_suppkey, (row_number() OVER (ORDER BY '{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey
        || ',"s_suppkey":' || s_suppkey || '}'))::BIGINT AS row_pos
    FROM supplier
    """,
)
def canonical_sort(spark, sf):
    from assayer.operators.ordering import numbered

    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    keyed = s.withColumn("_key", C.canonical_json(s, s.columns)).select("s_suppkey", "_key")
    return numbered(keyed, [], ["_key"]).drop("_key")


@query(
    "zero_count_row",
    """
    SELECT o_orderkey % 6 AS shape, count(*)::BIGINT AS n,
           count(*) FILTER (WHERE o_orderkey % 6 IN (0, 1))::BIGINT AS zero_counts
    FROM orders GROUP BY 1
    """,
)
def zero_count_row(spark, sf):
    k = F.col("o_orderkey") % 6
    one = lambda kind, text: F.struct(
        F.lit("n").alias("name"), F.lit(kind).alias("kind"), F.lit(text).alias("text")
    )
    cells = (
        F.when(k == 0, F.array(one("num", "0.0")))
        .when(k == 1, F.array(one("str", "0")))
        .when(k == 2, F.array(one("bool", "false")))
        .when(k == 3, F.array(one("num", "0"), one("num", "0")))
        .when(k == 4, F.array(one("str", "no")))
        .otherwise(F.array(one("num", "0.5")))
    )
    rows = table(spark, sf, "orders").select(k.alias("shape"), cells.alias("cells"))
    rows = rows.select("shape", C.prepare(F.col("cells")).alias("prep"))
    return (
        rows.select("shape", grade.zero_count_row(F.lit(1), F.col("prep")).alias("zero"))
        .groupBy("shape")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("zero").alias("zero_counts"))
    )


@query(
    "more_columns",
    """
    SELECT p_size, count(*)::BIGINT AS n,
           count(*) FILTER (WHERE p_partkey % 4 > 1)::BIGINT AS wider
    FROM part GROUP BY p_size
    """,
)
def more_columns(spark, sf):
    pred = F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 4).cast("int")), lambda i: i.cast("string"))
    wider = grade.more_columns(pred, F.array(F.lit("a"), F.lit("b")))
    return (
        table(spark, sf, "part")
        .select("p_size", wider.alias("w"))
        .groupBy("p_size")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("w").alias("wider"))
    )


@query(
    "method_class",
    """
    WITH m AS (
        SELECT list_extract(['Set-Match', 'Exact', 'Value-Match', 'Ordered-List-Match', 'List-Match',
                'Scalar-Match', 'Exact-Scalar', 'Rubric', 'Something', 'Row-Set-Match'],
                (p_partkey % 10 + 1)::INT) AS method,
               CASE WHEN p_partkey % 3 = 0 THEN 'Scalar' ELSE 'Rows' END AS kind
        FROM part)
    SELECT method, kind,
           CASE WHEN method = 'Rubric' THEN 'rubric' WHEN kind = 'Scalar' THEN 'scalar'
                WHEN method LIKE '%Scalar%' THEN 'scalar' WHEN method LIKE '%List%' THEN 'ordered'
                ELSE 'set' END AS method_class,
           count(*)::BIGINT AS n
    FROM m GROUP BY ALL
    """,
)
def method_class(spark, sf):
    names = (
        "Set-Match Exact Value-Match Ordered-List-Match List-Match "
        "Scalar-Match Exact-Scalar Rubric Something Row-Set-Match"
    ).split()
    method = F.element_at(
        F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 10 + 1).cast("int")
    )
    kind = F.when(F.col("p_partkey") % 3 == 0, "Scalar").otherwise("Rows")
    m = table(spark, sf, "part").select(method.alias("method"), kind.alias("kind"))
    return (
        m.withColumn("method_class", grade.method_class(F.col("method"), F.col("kind")))
        .groupBy("method", "kind", "method_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "tolerance_override",
    """
    SELECT p_size, count(*)::BIGINT AS n,
           round(sum(CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.01 ELSE 0.000001 END), 6) AS total
    FROM part GROUP BY p_size
    """,
)
def tolerance_override(spark, sf):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "0.5").when(k == 1, "1e-2").when(k == 2, "loose")
    return (
        table(spark, sf, "part")
        .select("p_size", grade.tolerance(text).alias("tol"))
        .groupBy("p_size")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tol"), 6).alias("total"))
    )


@query(
    "safe_divide",
    """
    SELECT o_orderpriority, count(*) FILTER (WHERE o_custkey % 4 = 0)::BIGINT AS undefined,
           round(avg(o_totalprice / nullif(o_custkey % 4, 0)), 4) AS mean_ratio,
           coalesce(avg(CASE WHEN o_totalprice < 0 THEN o_totalprice END), 0.0) AS mean_of_none
    FROM orders GROUP BY o_orderpriority
    """,
)
def safe_divide(spark, sf):
    ratio = F.try_divide("o_totalprice", F.col("o_custkey") % 4)
    return (
        table(spark, sf, "orders")
        .select("o_orderpriority", "o_totalprice", ratio.alias("r"))
        .groupBy("o_orderpriority")
        .agg(
            F.count_if(F.col("r").isNull()).alias("undefined"),
            F.round(F.avg("r"), 4).alias("mean_ratio"),
            F.coalesce(
                F.avg(F.when(F.col("o_totalprice") < 0, F.col("o_totalprice"))), F.lit(0.0)
            ).alias("mean_of_none"),
        )
    )


@query(
    "fiscal_year",
    """
    SELECT year(o_orderdate - INTERVAL 3 MONTH)::BIGINT AS fiscal_year, count(*)::BIGINT AS n
    FROM orders GROUP BY 1
    """,
)
def fiscal_year(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(cal.fiscal_year(F.col("o_orderdate")).cast("long").alias("fiscal_year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "fiscal_quarter",
    """
    SELECT CASE WHEN month(l_shipdate) BETWEEN 4 AND 6 THEN 1 WHEN month(l_shipdate) BETWEEN 7 AND 9 THEN 2
                WHEN month(l_shipdate) >= 10 THEN 3 ELSE 4 END::BIGINT AS quarter,
           count(*)::BIGINT AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity
    FROM lineitem GROUP BY 1
    """,
)
def fiscal_quarter(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(cal.fiscal_quarter(F.col("l_shipdate")).cast("long").alias("quarter"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
        )
    )


TAX = "l_extendedprice::DECIMAL(14,2) * l_tax::DECIMAL(4,2)"


@query(
    "half_even_vs_half_up",
    f"""
    SELECT l_returnflag, count(*)::BIGINT AS n,
           count(*) FILTER (WHERE round_even({TAX}, 2) <> round({TAX}, 2))::BIGINT AS differ
    FROM lineitem GROUP BY l_returnflag
    """,
)
def half_even_vs_half_up(spark, sf):
    tax = F.col("l_extendedprice").cast("decimal(14,2)") * F.col("l_tax").cast("decimal(4,2)")
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.bround(tax, 2) != F.round(tax, 2)).alias("differ"),
        )
    )
