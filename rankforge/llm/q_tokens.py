"""op5: token ids of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm.common import table
from rankforge.llm.registry import register
from rankforge.llm.tokens import token_output


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


END_ID = 2


@register("op5_token_ids")
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    read, _ = token_output(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, with_ids=False)
    return read
