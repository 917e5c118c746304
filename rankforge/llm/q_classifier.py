"""op4: quality scores of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm.classifier import classify_quality
from rankforge.llm.common import table
from rankforge.llm.registry import register


@register("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
