"""From raw documents to tokens: toxicity, line dedup, near copies, source mix, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialmill.llm.queries import STAGES
from trialmill.session import new_path

#: Trained scores, iterated components and merges by rank are beyond SQL; tests compare each stage with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents, one after another; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
