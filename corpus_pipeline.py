"""A cleaning pipeline for training corpora: five operators in a row, each stage written and read again.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last return the
columns of ``documents``. A stage sees what its predecessor kept, and nothing else.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontaminate, jaccard, lineruns, toxicity
from assayer.llm.base import scratch, written
from assayer.session import table

#: Words in a shingle and the similarity from which documents are near duplicates.
SHINGLE, SIMILAR = 5, (80, 100)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go. A fifth of the labels stays unused, for judging the result."""
    labels = table(spark, sf_dir, "labels").where("crc32(cast(doc_id as string)) % 5 != 0")
    return toxicity.scored(docs, labels).where("predicted = 0").select(*docs.columns)


def without_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go from the texts; documents of which nothing is left go."""
    return lineruns.deduped(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar shingle sets, the one with the smallest id stays."""
    return jaccard.representatives(docs, size=SHINGLE, num=SIMILAR[0], den=SIMILAR[1])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and digests of ids and decoded text."""
    return bpe.encode_ids(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_runs),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokenized),
]

#: No SQL: scores of a trained network decide in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for i, (_, stage) in enumerate(STAGES, 1):
            docs = written(stage(spark, docs, sf_dir), "stage", keep=i == len(STAGES))
    return docs
