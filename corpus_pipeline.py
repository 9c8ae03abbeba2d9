"""The corpus pipeline: five stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, mixing, suffix, toxicity
from tessera.llm._graph import shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from ``labels`` of the documents it is given. Without labels of both kinds all stay."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links at 0.8 on shingles of five words."""
    return jaccard.keep_one(docs, width=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 100 bytes or more that also start earlier."""
    return suffix.remove_repeats(docs, length=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a tenth of its length in edits."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed table: a row for each repetition of a document."""
    return mixing.sample(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", one_of_near_copies),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixture),
]

#: No SQL expresses a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is deleted when the next one is written; the last one stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
        before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """By the file system that the path belongs to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
