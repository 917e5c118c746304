"""Stages of the pipeline: each keeps or repeats whole rows of ``documents``.

Rows are judged one by one: a doc_id may be null or repeated, any column may be
null, columns may clash with each other or with names used here, and an empty
table gives an empty table. What a stage writes on the way is deleted before it
returns; only its decisions, a few numbers per row, stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.classifier import THRESHOLD, fit_quality, fold_of, score_quality, with_statistics
from rankforge.llm.common import table
from rankforge.llm.decontaminate import find_leaks
from rankforge.llm.jaccard import jaccard_groups
from rankforge.llm.mixing import mix_sources
from rankforge.llm.q_tokens import END_ID, tokenizer_path
from rankforge.llm.tokens import token_output
from rankforge.plans.groups import rank_within
from rankforge.session import intermediates, shared_dir

BROADCAST_ROWS = 1_000_000
ROW = "_row_number"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, outside of what ``intermediates`` deletes."""
    path = f"{shared_dir(df.sparkSession)}/rankforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Numbered:
    """A table with a number of its own for each row; its columns are kept by place.

    A table read from files is cut the same way at every reading in a session, so
    its rows are numbered as they are read. Any other plan is written once, so that
    numbers stay the same. Null, repeated and equal rows have different numbers.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        rows = docs.toDF(*[f"_{i}" for i in range(len(self.names))]).withColumn(ROW, F.monotonically_increasing_id())
        scanned = docs._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LogicalRelation"
        self.rows = rows if scanned else settle(rows)

    def view(self, *names: str) -> DataFrame:
        """The numbers and the columns of these exact names (of equal names the first)."""
        return self.rows.select(ROW, *[F.col(f"_{self.names.index(n)}").alias(n) for n in names])

    def whole(self, rows: DataFrame) -> DataFrame:
        """The given columns in their order, without the numbers."""
        return rows.select(*[f"_{i}" for i in range(len(self.names))]).toDF(*self.names)

    def without(self, gone: DataFrame) -> DataFrame:
        """Rows whose number is not in ``gone`` (a written table): few numbers are broadcast after a count, many joined."""
        gone = gone.select(F.col(ROW).alias("_gone"))
        if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            gone = F.broadcast(gone)
        return self.whole(self.rows.join(gone, F.col(ROW) == F.col("_gone"), "left_anti"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier accepts; it is fitted as in ``classify_quality``."""
    numbered, labels = Numbered(docs), table(spark, sf_dir, "labels")
    with intermediates(spark):
        stats = with_statistics(numbered.view("text"), ROW, "text")
        ids = numbered.view("doc_id").select(F.col(ROW).alias("_key"), F.col("doc_id").alias("_id"))
        ids = ids.join(labels.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
        known = stats.select("_key", "_stats").join(ids, "_key")
        known = known.select(F.col("_id").alias("_key"), fold_of(F.col("_id")).alias("_fold"), "_stats")
        scored = score_quality(stats, fit_quality(known, labels))
        gone = settle(scored.where(F.col("score") < THRESHOLD).select(F.col("_key").alias(ROW)))
    return numbered.without(gone)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each near-duplicate group, one row only.

    Five-word shingles and a similarity of 0.8. Rows without words are no
    duplicates. Rows without doc_id come after those that have one.
    """
    numbered = Numbered(docs)
    with intermediates(spark):
        groups = jaccard_groups(numbered.view("text"), width=5, similarity=(80, 100), key=ROW)
        groups = settle(groups.where(F.col("n_shingles") > 0).select(ROW, "component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW))
    kept = numbered.view("doc_id").join(groups, ROW).groupBy("component_id").agg(first.alias("_first"))
    return numbered.without(settle(groups.join(kept.select(F.col(f"_first.{ROW}").alias(ROW)), ROW, "left_anti").select(ROW)))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a test item."""
    numbered = Numbered(docs)
    with intermediates(spark):
        gone = settle(find_leaks(numbered.view("text"), table(spark, sf_dir, "benchmark"), key=ROW).select(ROW).distinct())
    return numbered.without(gone)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; those with no copy are left out.

    What a row gets depends on its doc_id, text and source alone, not on its place;
    rows equal in all three share their copies evenly.
    """
    numbered = Numbered(docs)
    content = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    rows = numbered.view("doc_id", "text", "source").withColumn("_same", F.sha2(content, 256))
    with intermediates(spark):
        mixed = mix_sources(rows, key="_same").groupBy("_same", "source").agg(F.sum("copies").alias("_c"), F.count(F.lit(1)).alias("_m"))
        mixed = mixed.select(F.col("_same").alias("_k"), F.col("source").alias("_s"), "_c", "_m")
        placed = rank_within(rows.select(ROW, "_same", "source"), ["_same", "source"], [F.col(ROW)], "_r")
        share = F.floor(F.col("_c") / F.col("_m"))
        given = share + (F.col("_r") <= F.col("_c") - share * F.col("_m")).cast("long")
        both = placed.join(mixed, (F.col("_same") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")))
        taken = settle(both.select(F.col(ROW).alias("_taken"), given.cast("int").alias("_n")).where(F.col("_n") > 0))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_n")))
    return numbered.whole(numbered.rows.join(taken, F.col(ROW) == F.col("_taken")).withColumn("_copy", copies))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all rows, read back: ``doc_id, start, n_tokens, ids_crc32``.

    Null texts are empty ones; null and repeated doc_ids stay as rows of their own.
    """
    read, _ = token_output(docs, tokenizer_path(), END_ID, with_ids=False)
    return read
