"""op12: byte-level BPE of ``documents``, encoded and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.bpe import decode_bpe, encode_bpe
from rankforge.llm.common import table
from rankforge.llm.registry import register


def rank_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@register("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = rank_file()
    coded = encode_bpe(table(spark, sf_dir, "documents"), path, pattern)
    both = decode_bpe(coded, path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
