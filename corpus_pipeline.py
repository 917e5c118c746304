"""The training-data pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import stages
from rankforge.session import remove, shared_dir

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("n-gram Jaccard join", stages.keep_one_of_each),
    ("benchmark decontamination", stages.keep_uncontaminated),
    ("source mixing", stages.mix),
    ("token-id output", stages.tokenise),
]
#: SQL cannot express the fitted and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every hand-over is a written table, deleted once the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/rankforge/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
