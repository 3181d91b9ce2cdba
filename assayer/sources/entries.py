"""Board entries from a folder of JSON documents; nothing is read from an invalid set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import rules as R
from assayer.sources.answers import refuse

METRIC = "struct<mean:double,std:double,runs:array<double>,n:bigint,unavailable_reason:string>"
NAMED_METRICS = (
    "execution_accuracy", "session_accuracy", "multi_turn_session_accuracy",
    "multi_turn_turn_accuracy", "pass_any", "pass_all", "cost_usd_per_task", "median_latency_s",
)
ENTRY = (
    "entry_id string, "
    "system struct<name:string,version:string,organization:string,url:string,open_source:boolean,"
    "kind:string,arm:string>, "
    "model struct<name:string,provider:string,access:string,temperature:double>, "
    "protocol struct<split:string,corpus_version:string,data_snapshot_id:string,"
    "scorer_version:string,runs:bigint,denominator:bigint,attempted:bigint,evaluated_at:string>, "
    "results struct<"
    + ",".join(f"{m}:{METRIC}" for m in NAMED_METRICS)
    + ",by_tier:map<string,double>,by_session:map<string,struct<turns_passed:bigint,"
    "turns_total:bigint,session_passed:boolean>>>, "
    "declarations struct<canary_check:string,test_data_seen:boolean,human_in_loop:boolean>"
)


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(row_id, doc, stem): one document per file, or per line."""
    files = spark.read.text(path, wholetext=not lines).select(
        F.col("value").alias("doc"), F.col("_metadata.file_path").alias("stem")
    )
    entry = F.get_json_object("doc", "$.entry_id")
    return files.select(F.coalesce(entry, F.col("stem")).alias("row_id"), "doc", "stem")


def typed_entries(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json("doc", ENTRY).alias("e")).select("e.*")


def load_entries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Typed entries; raises when any document is invalid, with the number of violations and the folder
    that holds all of them.

    Files are checked for their names as well, lines have none to check.
    """
    docs = read_documents(spark, path, lines)
    refuse(R.check_entries(docs, None if lines else "stem"), "violations of entries")
    return typed_entries(docs)
