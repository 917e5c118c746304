"""Helpers that several operators of this package share."""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
# Rows whose texts and results a worker holds as Python objects in ``map_slices``.
ROWS_AT_ONCE = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Project columns by exact name.

    Renaming by position first keeps a table usable that also holds a column
    of the same name in other letters, or the same name twice (the first counts).
    """
    at = [df.columns.index(n) for n in names]
    by_place = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: Sequence[tuple[str, str]]) -> DataFrame:
    """A list as a DataFrame that is part of the plan: no job and no Python on executors.

    The whole list is one literal, so planning does not grow with the number of rows.
    """
    names = [name for name, _ in schema]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    kinds = ", ".join(f"{name}: {kind}" for name, kind in schema)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>")))


# What tasks leave in their worker process for the next tasks of their kind.
_KEPT = "rankforge_worker_kept"


def worker_kept() -> dict:
    """Large objects that outlive a task; they stay until the worker runs ``map_texts`` for other work."""
    return sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__


def _alone(run: Callable) -> Callable:
    """``run`` in a worker that first lets go of what tasks of another kind have kept."""

    def only(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.modules.pop(_KEPT, None)
        yield from run(frames)

    return only


def map_texts(rows: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """``rows`` (columns ``_key`` and others) through an Arrow function that returns ``_key`` and ``schema``.

    Keys travel as text, so that null and very large integers come back as they were.
    """
    kind = rows.schema["_key"].dataType
    done = rows.withColumn("_key", F.col("_key").cast("string")).mapInPandas(_alone(run), f"_key string, {schema}")
    return done.select(F.col("_key").cast(kind).alias(key), *[F.col(f"`{c}`") for c in done.columns[1:]])


def map_slices(rows: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """As ``map_texts``, with Arrow slices of few rows in and out.

    A worker holds the batch that Spark hands over, but never all its texts as
    Python objects, nor the results of more than one slice.
    """
    kind = rows.schema["_key"].dataType
    done = rows.withColumn("_key", F.col("_key").cast("string")).mapInArrow(_alone(sliced(run)), f"_key string, {schema}")
    return done.select(F.col("_key").cast(kind).alias(key), *[F.col(f"`{c}`") for c in done.columns[1:]])


def sliced(run: Callable, rows: int = ROWS_AT_ONCE) -> Callable:
    """``run`` on an iterator of batches of ``rows`` rows at most."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows))

    return some


def list_column(parts: Sequence[np.ndarray]) -> pa.ListArray:
    """One list of 64-bit integers per row."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
