"""op3: documents joined by shingle similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm.common import table
from rankforge.llm.jaccard import jaccard_groups
from rankforge.llm.registry import register


@register("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("set_id")
