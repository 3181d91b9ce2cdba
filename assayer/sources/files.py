"""File trees, file fingerprints, table schemas from DDL and statement runs."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Collection
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import cells as C
from assayer.operators import compare as K
from assayer.operators import grade as G
from assayer.session import fresh_path


def tree(spark: SparkSession, root: str, keep: str | None = None) -> DataFrame:
    """(doc, text) of every file below a folder, each file whole; ``keep`` is a name pattern."""
    reader = spark.read.option("recursiveFileLookup", True)
    if keep:
        reader = reader.option("pathGlobFilter", keep)
    path = F.col("_metadata.file_path")
    return reader.text(root, wholetext=True).select(path.alias("doc"), F.col("value").alias("text"))


def fingerprints(spark: SparkSession, root: str, keep: str = "*") -> DataFrame:
    """SHA-256 and size of every data file below a folder (a file has to stay under 2 GB)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", keep)
        .load(root)
        .select(
            F.regexp_extract("path", "([^/]+)$", 1).alias("file"),
            "length",
            F.sha2("content", 256).alias("sha256"),
        )
    )


def content_fingerprint(columns: list[Column]) -> Column:
    """Aggregate of a table's content: the sum of 48 bits of each row's MD5, as text.

    Rows are hashed where they lie and only sums move, so neither files nor row order matter, and
    any number of rows of any file size will do. A null differs from every text but ``~``.
    """
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")
    return F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(38,0)").cast("string")


def _hashable(c: Column, dtype: T.DataType) -> Column:
    """Maps as sorted entries; every other type hashes by its own bytes: bits of doubles, elements of vectors, microseconds."""
    return F.array_sort(F.map_entries(c)) if isinstance(dtype, T.MapType) else c


def content_manifest(df: DataFrame, name: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """(table, column, n_rows, first, second): order-free multiset hashes of every column, and of whole rows as column ``*``.

    One scan with partial sums: two independent 64-bit hashes of each value are added up, so neither files nor row order
    matter, and manifests of parts of a table are added with ``merged_manifest``. Two sums of 128 bits together differ
    for any two contents but by chance. ``changed`` puts expressions in the place of columns.
    """
    changed = changed or {}
    df = df.select(*[changed.get(f.name, F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    values = {f.name: [F.lit(f.name), _hashable(F.col(f"`{f.name}`"), f.dataType)] for f in df.schema.fields}
    values["*"] = [x for v in values.values() for x in v]
    total = lambda seed, v: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *v).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    sums = [F.struct(F.lit(c).alias("column"), total(1, v).alias("first"), total(2, v).alias("second")) for c, v in values.items()]
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*sums).alias("sums"))
    return out.select(F.lit(name).alias("table"), "n_rows", F.explode("sums").alias("s")).select("table", "s.column", "n_rows", "s.first", "s.second")


def merged_manifest(parts: DataFrame) -> DataFrame:
    """The manifest of a table from those of its parts."""
    total = lambda c: F.sum(c).cast("decimal(38,0)").alias(c)
    return parts.groupBy("table", "column").agg(F.sum("n_rows").cast("long").alias("n_rows"), total("first"), total("second"))


def manifest_differences(published: DataFrame, delivered: DataFrame) -> DataFrame:
    """(table, column, matches) of every column of either manifest."""
    kept = ["n_rows", "first", "second"]
    both = published.alias("p").join(delivered.alias("d"), ["table", "column"], "full_outer")
    same = F.lit(True)
    for c in kept:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"d.{c}"))
    return both.select("table", "column", same.alias("matches"))


def fingerprint_mismatches(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that differ from the manifest (file, sha256) or exist on one side only."""
    m = manifest.select("file", F.col("sha256").alias("expected"))
    return actual.join(m, "file", "full_outer").where(
        ~F.col("sha256").eqNullSafe(F.col("expected"))
    )


SQL_TYPES = {"VARCHAR": "STRING", "TIMESTAMP": "TIMESTAMP_NTZ"}  # fixed values


def declarations(ddl: str) -> dict[str, str]:
    """Column list of every ``CREATE TABLE`` of a DDL text, with the types that Spark knows."""
    out = {}
    for name, body in re.findall(r"CREATE TABLE\s+(\w+)\s*\((.*?)\);", ddl, re.S | re.I):
        body = re.sub(r"--[^\n]*", "", body)
        for old, new in SQL_TYPES.items():
            body = re.sub(rf"\b{old}\b", new, body)
        out[name] = body
    return out


def declared_names(body: str) -> list[str]:
    return [re.match(r"\s*(\w+)", part)[1] for part in re.split(r",(?![^<(]*[>)])", body)]


def schemas_from_ddl(ddl: str) -> dict[str, T.StructType]:
    """Typed schema of every ``CREATE TABLE`` of a DDL text; Spark reads the column lists."""
    return {name: T.StructType.fromDDL(body) for name, body in declarations(ddl).items()}


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with its declared schema: no inference, only declared columns are read."""
    return spark.read.schema(schema).parquet(path)


#: Statements that run at the same time.
AT_ONCE = 8
FAILURES = "run_id string, task_id string, error_type string, error_message string"
ANSWER_ROWS = f"task_id string, row_pos long, cells {C.CELLS}"


def run_statements(spark: SparkSession, statements: dict[str, str], scalar: Collection[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run each task's statement: (answer rows by task id, seconds by task id, failures by task id).

    Results go straight to the shared folder; only clock, size and error text come to the driver. A statement
    that does not parse, does not run, or is of a ``scalar`` task and gives anything but one cell, is a failure of its
    task and of no other.
    """
    out = fresh_path(spark, "answers")

    def run(task: tuple[str, str]) -> tuple[str, float, str | None, str | None]:
        task_id, text = task
        start, place = time.monotonic(), f"{out}/{uuid.uuid4().hex}"
        try:
            found = spark.sql(text)
            K.answer_rows(found, []).select(F.lit(task_id).alias("task_id"), "row_pos", "cells").write.parquet(place)
            if task_id in scalar:
                shape = (spark.read.schema(ANSWER_ROWS).parquet(place).count(), len(found.columns))
                if shape != (1, 1):
                    raise ValueError(f"Expected scalar shape (1,1), got {shape}")
            return task_id, time.monotonic() - start, place, None
        except Exception as exc:  # noqa: BLE001 - the label is the result
            return task_id, time.monotonic() - start, None, str(exc).split("\n")[0]

    with ThreadPool(AT_ONCE) as pool:
        log = pool.map(inheritable_thread_target(spark)(run), statements.items())
    done = [place for *_, place, error in log if error is None]
    rows = spark.read.schema(ANSWER_ROWS).parquet(*done) if done else spark.createDataFrame([], ANSWER_ROWS)
    seconds = spark.createDataFrame([(t, s) for t, s, *_ in log], "task_id string, latency_seconds double")
    failed = [(None, t, "gold_sql_execution_error", e) for t, *_, e in log if e is not None]
    return rows, seconds, spark.createDataFrame(failed, FAILURES)


def certify(spark: SparkSession, tasks: DataFrame, gold_head: DataFrame, gold: DataFrame, run: str = "gold") -> DataFrame:
    """Score the answers of each task's own ``gold_sql`` against its gold answer; failures are scores with a label."""
    found = tasks.select("task_id", "gold_sql", "answer_type").collect()  # statements are run from the driver
    statements = {r.task_id: r.gold_sql or "" for r in found}
    rows, seconds, failures = run_statements(spark, statements, {r.task_id for r in found if r.answer_type == "Scalar"})
    rows = rows.withColumn("run_id", F.lit(run))
    sent = tasks.join(failures, "task_id", "left_anti").select(F.lit(run).alias("run_id"), "task_id", F.lit("list").alias("raw"))
    heads = K.answer_heads(rows, sent, ["run_id", "task_id"]).join(seconds, "task_id")
    heads = heads.withColumn("generated_sql_present", F.lit(True)).withColumn("tool_calls", F.lit(1))
    return G.score_tasks(tasks, gold_head, gold, heads, rows, [run], failures=failures)
