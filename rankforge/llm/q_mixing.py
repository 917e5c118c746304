"""op6: mixing all documents to source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm.common import table
from rankforge.llm.mixing import mix_sources
from rankforge.llm.registry import register


@register("op6_source_mix")
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
