"""The corpus pipeline: stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinlog.llm import stages
from skeinlog.llm.common import staged

STAGES = [
    ("quality classifier", stages.quality_classifier),
    ("n-gram jaccard join", stages.ngram_jaccard_join),
    ("secret scans", stages.secret_scans),
    ("mixing sources", stages.mixing_sources),
    ("sentencepiece", stages.sentencepiece),
]

#: The classifier is trained, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return docs
