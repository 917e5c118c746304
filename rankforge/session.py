"""Session helpers: local sessions for tests and a place for cut lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "rankforge") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's own checkpoint folder.

    Only a local master may fall back to a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Owner of the written intermediates: on leaving the block they are deleted.

    Results of the block must have been written or collected inside it.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session has written."""
    place, system = _place(spark, path)
    system.delete(place, True)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder, in order; none where there is no folder."""
    place, system = _place(spark, folder)
    return sorted(e.getPath().getName() for e in system.listStatus(place)) if system.exists(place) else []


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear whole under its name; False where there is one already."""
    place, system = _place(spark, path)
    draft, _ = _place(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = system.create(draft, False)
    stream.write(text.encode())
    stream.close()
    if not system.exists(place) and system.rename(draft, place):
        return True
    system.delete(draft, False)
    return False


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write once to shared storage, read back as a plain scan.

    A written table survives lost executors, and later readers prune columns.
    Inside ``intermediates`` it is deleted at the end of the block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankforge/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
