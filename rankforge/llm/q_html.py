"""op7: main text of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm.common import table
from rankforge.llm.html import extract_main_text
from rankforge.llm.registry import register


@register("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
