"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau", "a"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, "  \n\t ", "b"),
    (6, "one", "b"),
    (7, LONG, "b"),
    (7, LONG, "b"),
    (None, "no key here but words", None),
    (None, None, "c"),
    (9, "Ünïcödé wörds, ß and 漢字 too\nsecond line\n\nfourth", "c"),
]
SCHEMA = "doc_id long, text string, source string"


def documents(spark: SparkSession, rows=TEXTS) -> DataFrame:
    """The rows with more columns whose names operators use inside or in other letters."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns(
        {"_key": F.lit("x"), "_text": F.lit(None).cast("string"), "size": F.lit(-1), "host": F.lit(0), "score": F.lit("s"), "spans": F.lit(1)}
    )


def clashing(df: DataFrame) -> DataFrame:
    """The same table with a second column of the same name in capitals."""
    return df.select("*", F.lit("capital").alias("TEXT"), F.lit("capital").alias("DOC_ID"))


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def by_row(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
