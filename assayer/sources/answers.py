"""Task, gold and prediction files as frames; any JSON answer shape as answer rows."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import cells as C
from assayer.session import fresh_path

TASK = (
    "task_id string, session_id string, tier int, sql_difficulty string, primary_axis string, "
    "secondary_axis string, data_snapshot_id string, interaction_mode string, "
    "turns array<struct<turn_id:string,turn_number:int,ground_truth:struct<gold_sql:string,"
    "gold_answer_path:string,gold_answer_sha256:string,gold_answer_type:string,"
    "scoring_method:string,expected_output_columns:array<string>,expected_row_count:bigint,"
    "value_tolerance:string>>>"
)
PREDICTION = (
    "task_id string, generated_sql string, latency_seconds double, cost_usd double, "
    "tool_calls int, sql_transpiled boolean"
)
GOLD = "task_id string, data_snapshot_id string, row_count bigint, columns array<string>, answer_sha256 string"


class InputError(ValueError):
    """A file does not have the required shape."""


def _texts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(value, file_path): one JSON document per file, or per line with ``lines``.

    One document per line is the form for large inputs: files split, no document has to be the
    size of a file.
    """
    return spark.read.text(path, wholetext=not lines).select(
        "value", F.col("_metadata.file_path").alias("file_path")
    )


def _read(spark: SparkSession, path: str, field: str, lines: bool = False) -> DataFrame:
    """(file_path, rec): elements of a top-level list, or of the list under ``field``."""
    as_list = F.from_json("value", "array<string>")
    inside = F.from_json("value", f"`{field}` array<string>")[field]
    rows = F.when(F.ltrim("value").startswith("["), as_list).otherwise(inside)
    files = _texts(spark, path, lines).select("file_path", rows.alias("recs"))
    checked = F.when(
        F.col("recs").isNull(),
        F.raise_error(F.concat(F.lit(f"expected a list or an object with {field}: "), "file_path")),
    ).otherwise(F.col("recs"))
    return files.select("file_path", F.explode(checked).alias("rec"))


def flat_tasks(records: DataFrame, rec: str = "rec") -> DataFrame:
    """One flat row per task from raw task JSON; only the first turn carries the ground truth."""
    t = F.from_json(rec, TASK)
    first = t["turns"][0]
    truth = first["ground_truth"]
    plain = "task_id session_id tier sql_difficulty primary_axis secondary_axis data_snapshot_id"
    return records.select(
        *[t[c].alias(c) for c in plain.split()],
        first["turn_number"].alias("turn_number"),
        truth["gold_answer_type"].alias("answer_type"),
        *[
            truth[c].alias(c)
            for c in (
                "scoring_method gold_sql gold_answer_path gold_answer_sha256 "
                "expected_output_columns expected_row_count value_tolerance"
            ).split()
        ],
    )


def load_tasks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return flat_tasks(_read(spark, path, "tasks", lines))


def load_gold(
    spark: SparkSession, folder: str, tasks: DataFrame, name: str = "([^/]+)$"
) -> DataFrame:
    """Gold artifacts joined to their tasks by file name; a task without a file is an error.

    ``name`` picks the joining part of a path; it is applied to both sides.
    """
    files = _texts(spark, folder).select(
        F.regexp_extract("file_path", name, 1).alias("file_name"), F.col("value").alias("rec")
    )
    wanted = tasks.select(
        "task_id",
        "gold_answer_sha256",
        F.regexp_extract("gold_answer_path", name, 1).alias("file_name"),
    )
    met = wanted.join(files, "file_name", "left")
    return met.withColumn(
        "rec",
        F.when(
            F.col("rec").isNull(),
            F.raise_error(F.concat(F.lit("gold answer file not found: "), "file_name")),
        ).otherwise(F.col("rec")),
    )


def prediction_problems(records: DataFrame) -> DataFrame:
    """Rows that make a submission unusable: no task id, or an id given twice in a run."""
    ids = records.select("run_id", F.get_json_object("rec", "$.task_id").alias("task_id"))
    missing = ids.where(F.coalesce("task_id", F.lit("")) == "").groupBy("run_id").agg(
        F.lit(None).cast("string").alias("task_id"),
        F.lit("missing_task_id").alias("problem"),
        F.count(F.lit(1)).alias("n"),
    )
    twice = (
        ids.where(F.coalesce("task_id", F.lit("")) != "")
        .groupBy("run_id", "task_id")
        .agg(F.lit("duplicate_task_id").alias("problem"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return missing.unionByName(twice)


def refuse(problems: DataFrame, what: str) -> None:
    """Raise if there are any ``problems``: all are written, a few are shown."""
    path = fresh_path(problems.sparkSession, what.replace(" ", "-"))
    problems.write.parquet(path)
    found = problems.sparkSession.read.schema(problems.schema).parquet(path)
    if many := found.count():
        shown = [tuple(r) for r in found.orderBy(*found.columns).take(5)]
        raise InputError(f"{many} {what}, all in {path}; the first: {shown}")


def load_predictions(
    spark: SparkSession,
    path: str,
    check: bool = True,
    lines: bool = False,
    run: str = r"([^/]+?)(?:\.[^./]*)?$",
) -> DataFrame:
    """(run_id, rec) of every prediction; by default the run is the file's stem."""
    records = _read(spark, path, "predictions", lines).select(
        F.regexp_extract("file_path", run, 1).alias("run_id"), "rec"
    )
    if check:
        refuse(prediction_problems(records), "problems of predictions")
    return records


# ---------------------------------------------------------------- answer shapes


def _kind(schema: Column) -> Column:
    return (
        F.when(schema.isNull() | (schema == "VOID"), "null")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "STRING", "str")
        .when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "num")
        .otherwise("other")
    )


def _value_cell(name: Column, schema: Column, text: Column) -> Column:
    """Cell of one JSON value; arguments should be plain columns or struct fields."""
    kind = _kind(schema)
    number = F.when(text.rlike(r"^-?\d+$"), text).otherwise(C.float_text(text.try_cast("double")))
    clean = (
        F.when(kind == "num", number)
        .when(kind == "str", C.midnight_to_date(C.normalize_text(text)))
        .when(kind != "null", text)
    )
    return F.struct(
        name.alias("name"),
        F.when(kind == "null", "null").otherwise(kind).alias("kind"),
        clean.alias("text"),
    )


def _schema_of(v: Column) -> Column:
    return F.call_function("schema_of_variant", v)


def _with_cells(df: DataFrame, text: str, schema: str, into: str) -> DataFrame:
    """Add the cells of a JSON value: an object's in its own key order, else one ``value`` cell.

    The steps are separate projections so that the text is parsed once per row.
    """
    is_object = F.col(schema).startswith("OBJECT")
    df = df.withColumn("_m", F.when(is_object, F.from_json(text, "map<string,string>"))).withColumn(
        "_v", F.when(is_object, F.from_json(text, "map<string,variant>"))
    )
    df = df.withColumn(
        "_e",
        F.when(
            is_object,
            F.expr(
                "transform(map_keys(_m), k -> named_struct("
                "'n', k, 's', schema_of_variant(_v[k]), 't', _m[k]))"
            ),
        ).otherwise(
            F.array(
                F.struct(
                    F.lit("value").alias("n"), F.col(schema).alias("s"), F.col(text).alias("t")
                )
            )
        ),
    )
    cells = F.transform("_e", lambda e: _value_cell(e["n"], e["s"], e["t"]))
    return df.withColumn(into, cells).drop("_m", "_v", "_e")


def _record_text(cells: str) -> Column:
    """Text of a whole record, equal for equal records whatever their key order."""
    named = F.transform(
        cells, lambda c: F.struct(c["name"].alias("n"), C.cell_token(c).alias("t"))
    )
    return F.to_json(F.array_sort(named))


def _other(text: Column) -> Column:
    return F.struct(F.lit("value").alias("name"), F.lit("other").alias("kind"), text.alias("text"))


def parse_answers(
    records: DataFrame, keys: list[str], fields: tuple[str, ...] = ("predicted_answer", "answer")
) -> tuple[DataFrame, DataFrame]:
    """(head, rows) of the answers found under the first present field of ``rec``.

    A list, a record, a list of scalars, a single scalar, ``[]`` and ``null`` all stay apart. A record that is no JSON
    (cut off, nested too deep, a key given twice, ``NaN``) has the raw kind ``unreadable`` and no rows; it fails no other.
    """
    first_of = lambda pick: F.coalesce(*[F.when(F.col("field") == f, pick(f)) for f in fields])
    base = (
        records.select(
            *keys,
            F.try_parse_json("rec").isNull().alias("unreadable"),
            F.json_object_keys("rec").alias("present"),
            F.from_json("rec", ", ".join(f"`{f}` string" for f in fields)).alias("as_text"),
            F.from_json("rec", ", ".join(f"`{f}` variant" for f in fields)).alias("as_variant"),
        )
        .withColumn(
            "field",
            F.coalesce(*[F.when(F.array_contains("present", f), F.lit(f)) for f in fields]),
        )
        .select(
            *keys,
            "unreadable",
            "field",
            first_of(lambda f: F.col("as_text")[f]).alias("text"),
            F.coalesce(
                first_of(lambda f: _schema_of(F.col("as_variant")[f])), F.lit("VOID")
            ).alias("schema"),
        )
    )
    base = _with_cells(base, "text", "schema", "cells")
    is_dict = F.col("schema").startswith("OBJECT")
    wrapped = F.expr(
        "try_element_at(filter(transform(array('answer', 'rows', 'result', 'data'), "
        "k -> try_element_at(filter(cells, c -> c.name = k), 1)), "
        "c -> c.kind = 'other' and startswith(c.text, '[')), 1).text"
    )
    base = base.withColumn(
        "list_text", F.when(F.col("schema").startswith("ARRAY"), F.col("text")).when(is_dict, wrapped)
    )
    base = base.withColumn("_t", F.from_json("list_text", "array<string>")).withColumn(
        "_s", F.transform(F.from_json("list_text", "array<variant>"), _schema_of)
    )
    base = base.withColumn(
        "items",
        F.zip_with("_t", "_s", lambda t, s: F.struct(t.alias("text"), s.alias("schema"))),
    ).drop("_t", "_s")

    head = base.withColumn(
        "raw",
        F.when(F.col("unreadable"), "unreadable")
        .when(F.col("field").isNull(), "missing_answer")
        .when(F.col("schema") == "VOID", "null")
        .when((F.col("schema") == "STRING") & (F.col("text") == ""), "empty_text")
        .when(F.col("schema").startswith("ARRAY"), "list")
        .when(is_dict, "dict")
        .otherwise("scalar"),
    ).withColumn("n_items", F.size("items"))
    head = head.withColumn("one_text", F.try_element_at("items", F.lit(1))["text"]).withColumn(
        "one_schema", F.coalesce(F.try_element_at("items", F.lit(1))["schema"], F.lit("VOID"))
    )
    head = _with_cells(head, "one_text", "one_schema", "first_cells")
    of_keys = F.expr(
        "try_element_at(filter(transform(array('answer', 'value', 'result'), "
        "k -> try_element_at(filter(cells, c -> c.name = k), 1)), "
        "c -> c is not null and c.kind <> 'other'), 1)"
    )
    many = F.to_json(
        F.transform("items", lambda i: C.token(_kind(i["schema"]), F.coalesce(i["text"], F.lit(""))))
    )
    raw_is = lambda name: F.col("raw") == name
    value = (
        F.when(raw_is("scalar"), F.col("cells")[0])
        .when(raw_is("dict") & (F.size("cells") == 1), F.col("cells")[0])
        .when(raw_is("dict"), F.coalesce(of_keys, _other(_record_text("cells"))))
        .when(raw_is("list") & (F.col("n_items") == 1) & (F.size("first_cells") == 1),
              F.col("first_cells")[0])
        .when(raw_is("list") & (F.col("n_items") == 1), _other(_record_text("first_cells")))
        .when(raw_is("list") & (F.col("n_items") > 1), _other(many))
    )
    null_cell = F.expr(
        "named_struct('name', 'value', 'kind', 'null', 'text', cast(null as string))"
    )
    is_list = F.col("list_text").isNotNull()
    names = lambda cells: F.transform(cells, lambda c: c["name"])
    out_head = head.select(
        *keys,
        "raw",
        F.when(is_list | raw_is("dict"), "list").otherwise("value").alias("shape"),
        F.when(is_list, F.col("n_items"))
        .when(F.col("raw").isin("dict", "scalar"), 1)
        .otherwise(0)
        .cast("long")
        .alias("n_rows"),
        F.when(is_list & (F.col("n_items") == 0), F.array().cast("array<string>"))
        .when(is_list, names("first_cells"))
        .otherwise(names("cells"))
        .alias("columns"),
        F.coalesce(value, null_cell).alias("value"),
    )
    listed = base.where(is_list).select(*keys, F.posexplode("items").alias("row_pos", "i"))
    listed = listed.select(
        *keys,
        F.col("row_pos").cast("long").alias("row_pos"),
        F.col("i.text").alias("_text"),
        F.coalesce("i.schema", F.lit("VOID")).alias("_schema"),
    )
    listed = _with_cells(listed, "_text", "_schema", "cells").drop("_text", "_schema")
    single = base.where(~is_list & (F.col("schema") != "VOID")).select(
        *keys, F.lit(0).cast("long").alias("row_pos"), "cells"
    )
    return out_head, listed.unionByName(single)


def prediction_fields(records: DataFrame) -> DataFrame:
    """The scalar fields of each prediction."""
    p = F.from_json("rec", PREDICTION)
    return records.select(
        "run_id",
        p["task_id"].alias("task_id"),
        (F.coalesce(p["generated_sql"], F.lit("")) != "").alias("generated_sql_present"),
        *[p[c].alias(c) for c in ("latency_seconds", "cost_usd", "tool_calls")],
        F.coalesce(p["sql_transpiled"], F.lit(False)).alias("sql_transpiled"),
    )


# ---------------------------------------------------------------- gold artifacts


@F.pandas_udf(T.StringType())
def artifact_sha256(answers: pd.Series) -> pd.Series:
    """SHA-256 of the answer's compact, key-sorted JSON (float text has no builtin equivalent)."""

    def one(text):
        if text is None:
            return None
        plain = json.dumps(
            json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":")
        )
        return hashlib.sha256(plain.encode("utf-8")).hexdigest()

    return answers.map(one)


def gold_hash_mismatches(gold: DataFrame) -> DataFrame:
    """Artifacts (task_id, rec, gold_answer_sha256) whose answer is not the recorded one."""
    answer = F.to_json(F.from_json("rec", "answer variant")["answer"])
    text = F.get_json_object("rec", "$.answer")
    is_text = F.call_function(
        "schema_of_variant", F.from_json("rec", "answer variant")["answer"]
    ).isin("STRING")
    raw = F.when(is_text, answer).otherwise(F.coalesce(text, F.lit("null")))
    return (
        gold.withColumn("computed", artifact_sha256(raw))
        .where(F.coalesce("gold_answer_sha256", F.lit("")) != "")
        .where(F.col("computed") != F.col("gold_answer_sha256"))
        .select("task_id", F.col("gold_answer_sha256").alias("recorded"), "computed")
    )


def expand_questions(
    spark: SparkSession, path: str, multi_turn_tier: int = 9, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """A published question file as (tasks, gold) frames."""
    shape = (
        "task_id string, tier int, sql_difficulty string, primary_axis string, "
        "answer_type string, scoring_method string, value_tolerance string, gold_sql string, "
        "gold struct<row_count:bigint,columns:array<string>,answer_sha256:string,answer:string>"
    )
    files = _texts(spark, path, lines).select(
        F.from_json("value", "data_snapshot_id string, questions array<string>").alias("f")
    )
    recs = files.select(
        F.col("f.data_snapshot_id").alias("data_snapshot_id"), F.explode("f.questions").alias("rec")
    )
    q = recs.withColumn("q", F.from_json("rec", shape))
    multi = F.col("q.tier") == multi_turn_tier
    tasks = q.select(
        "q.task_id",
        F.when(multi, F.regexp_replace("q.task_id", "_T[^_]*$", ""))
        .otherwise(F.col("q.task_id"))
        .alias("session_id"),
        F.lit(1).alias("turn_number"),
        "q.tier",
        "q.sql_difficulty",
        "q.primary_axis",
        "data_snapshot_id",
        F.when(multi, "multi_turn").otherwise("single_turn").alias("interaction_mode"),
        "q.answer_type",
        "q.scoring_method",
        "q.gold_sql",
        F.concat(F.lit("gold_answers/"), "q.task_id", F.lit(".json")).alias("gold_answer_path"),
        F.col("q.gold.answer_sha256").alias("gold_answer_sha256"),
        F.col("q.gold.columns").alias("expected_output_columns"),
        F.col("q.gold.row_count").alias("expected_row_count"),
        "q.value_tolerance",
    )
    gold = q.select(
        "q.task_id",
        "data_snapshot_id",
        "q.gold_sql",
        F.col("q.gold.row_count").alias("row_count"),
        F.col("q.gold.columns").alias("columns"),
        F.col("q.gold.answer_sha256").alias("answer_sha256"),
        F.get_json_object("rec", "$.gold").alias("rec"),
    )
    return tasks, gold
