"""Sidecar trees of pooled object vectors as a Spark data source.

A tree holds one archive per frame, ``scene_0100/<camera>/0007.npz``, with the half
precision vectors of its candidates. Reading plans its partitions from a listing,
into which conditions on scene, camera and frame are pushed, and opens many files
per task. Writing stages files and moves them to their names when the whole job has
succeeded; frames that a tree already holds are left out before they are computed.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from rankforge import schemas as S
from rankforge.sources.catalog import parse_frame_path

FORMAT = "frame_sidecars"
COLUMNS = ["scene_id", "frame_id", "camera", "cand_idx", "pooled"]
SCHEMA = "scene_id int, frame_id int, camera string, cand_idx long, pooled array<float>"
# Fixed member names of a sidecar archive.
M_POOLED, M_SOURCE = "object_pooled", "source_relative_path"
STAGING = "_staging"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PARTITION_BYTES = 32 * 2**20
BATCH_BYTES = 8 * 2**20
_FILE = re.compile(r"scene_(\d+)/([^/]+)/(\d+)\.npz$")

_TESTS = {
    EqualTo: lambda v, f: v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
}


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a path with or without a scheme."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Files(InputPartition):
    """Files of one task: path, scene, frame and camera."""

    files: list[tuple[str, int, int, str]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: relative paths below its staging folder."""

    folder: str
    files: list[str]


class WholeTreeReader(DataSourceReader):
    """Lists every file; Spark refuses readers with ``pushFilters`` where filters are not pushed."""

    def __init__(self, root: str, partition_bytes: int):
        self.root, self.partition_bytes, self.tests = root, partition_bytes, []

    def _wanted(self, scene: int, frame: int | None, camera: str | None) -> bool:
        """Whether a file, or a folder of which a part is known, may hold wanted rows."""
        known = {("scene_id",): scene, ("frame_id",): frame, ("camera",): camera}
        return all(known[f.attribute] is None or _TESTS[type(f)](known[f.attribute], f) for f in self.tests)

    def _listed(self) -> Iterator[tuple[str, int, int, str, int]]:
        system, root = _place(self.root)
        if system.get_file_info(root).type == pafs.FileType.NotFound:
            return
        for top in sorted(system.get_file_info(pafs.FileSelector(root)), key=lambda i: i.path):
            scene = re.fullmatch(r"scene_(\d+)", top.base_name)
            # A scene that no condition allows is not listed.
            if scene is None or not self._wanted(int(scene[1]), None, None):
                continue
            for info in sorted(system.get_file_info(pafs.FileSelector(top.path, recursive=True)), key=lambda i: i.path):
                name = _FILE.search(info.path)
                if name and self._wanted(int(name[1]), int(name[3]), name[2]):
                    yield info.path, int(name[1]), int(name[3]), name[2], info.size

    def partitions(self) -> list[Files]:
        parts, size = [Files()], 0
        for *file, length in self._listed():
            if parts[-1].files and size + length > self.partition_bytes:
                parts.append(Files())
                size = 0
            parts[-1].files.append(tuple(file))
            size += length
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for path, scene, frame, camera in partition.files:
            system, _ = _place(self.root)
            with system.open_input_stream(path) as stream, np.load(io.BytesIO(stream.read()), allow_pickle=False) as archive:
                pooled = archive[M_POOLED].astype(np.float32)
            if pooled.ndim != 2:
                raise ValueError(f"{path}: pooled vectors must have rank 2")
            held.append((scene, frame, camera, pooled))
            size += pooled.nbytes
            if size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(held: list[tuple]) -> pa.RecordBatch:
        """Frames of several files as one batch; vectors may differ in length between frames."""
        rows = [len(p) for *_, p in held]
        widths = np.concatenate([np.full(len(p), p.shape[1], np.int64) for *_, p in held])
        offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
        values = pa.array(np.concatenate([p.ravel() for *_, p in held]), pa.float32())
        columns = [
            pa.array(np.repeat(np.array([h[0] for h in held], np.int32), rows)),
            pa.array(np.repeat(np.array([h[1] for h in held], np.int32), rows)),
            pa.array(np.repeat(np.array([h[2] for h in held], object), rows), pa.string()),
            pa.array(np.concatenate([np.arange(n, dtype=np.int64) for n in rows])),
            pa.ListArray.from_arrays(pa.array(offsets), values),
        ]
        return pa.RecordBatch.from_arrays(columns, names=COLUMNS)


class SidecarReader(WholeTreeReader):
    """Lists the files that pushed conditions allow."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on scene, camera and frame choose files; the others stay with Spark."""
        for f in filters:
            if type(f) in _TESTS and getattr(f, "attribute", None) in (("scene_id",), ("camera",), ("frame_id",)):
                self.tests.append(f)
            else:
                yield f


class SidecarWriter(DataSourceArrowWriter):
    """Stages one file per frame; rows of a frame lie behind each other, in candidate order."""

    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        # A folder per attempt: a task that runs twice does not meet its own files.
        folder = f"{self.root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        system, inner = _place(folder)
        files: list[str] = []
        at, vectors = None, []

        def close() -> None:
            scene, frame, camera = at
            name = f"scene_{scene:04d}/{camera}/{frame:04d}.npz"
            data = io.BytesIO()
            width = max(map(len, vectors), default=0)
            if any(len(v) != width for v in vectors):
                raise ValueError(f"{name}: vectors of one frame must have one length")
            matrix = np.asarray(vectors, np.float32).reshape(len(vectors), width).astype(np.float16)
            np.savez(data, **{M_POOLED: matrix, M_SOURCE: np.array(name)})
            system.create_dir(f"{inner}/{name}".rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{inner}/{name}") as out:
                out.write(data.getvalue())
            files.append(name)

        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("scene_id", "frame_id", "camera", S.CANDIDATE, "pooled")]
            for *key, candidate, vector in zip(*columns):
                if key != at:
                    if at is not None:
                        close()
                    at, vectors = key, []
                if candidate != len(vectors):
                    raise ValueError(f"frame {key}: candidates must count from 0 without gaps, found {candidate} at {len(vectors)}")
                vectors.append(vector)
        if at is not None:
            close()
        return Staged(folder, files)

    def commit(self, messages: list[Staged | None]) -> None:
        """All tasks have succeeded: move their files to their names."""
        system, root = _place(self.root)
        for message in messages:
            if message is None:
                continue
            _, inner = _place(message.folder)
            for name in message.files:
                system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                system.move(f"{inner}/{name}", f"{root}/{name}")
        self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        """A task has failed: the tree stays as it was."""
        self._clean()

    def _clean(self) -> None:
        system, staging = _place(f"{self.root}/{STAGING}/{self.job}")
        if system.get_file_info(staging).type == pafs.FileType.Directory:
            system.delete_dir(staging)


class FrameSidecars(DataSource):
    """``spark.read.format("frame_sidecars").load(root)`` and ``df.write.format("frame_sidecars").mode("append").save(root)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WholeTreeReader:
        kind = SidecarReader if self.options.get("pushFilters", "false").lower() == "true" else WholeTreeReader
        return kind(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> SidecarWriter:
        if overwrite:
            raise ValueError("sidecar trees are appended to; remove the frames that shall be written again")
        return SidecarWriter(self.options["path"])


def read_sidecars(spark: SparkSession, root: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Pooled vectors of every candidate below ``root``, one row each.

    Filters on ``scene_id``, ``camera`` and ``frame_id`` choose files where
    ``spark.sql.python.filterPushdown.enabled`` is set as this is called; results are
    the same without.
    A missing or empty tree has no rows.
    """
    spark.dataSource.register(FrameSidecars)
    pushed = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format(FORMAT).option("partitionBytes", partition_bytes).option("pushFilters", pushed).load(root)


def missing_frames_of(df: DataFrame, root: str) -> DataFrame:
    """Rows of the frames that the tree does not hold yet; only file names are read."""
    spark = df.sparkSession
    system, inner = _place(root)
    if system.get_file_info(inner).type == pafs.FileType.NotFound:
        return df
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(root)
    files = files.where(~F.col("path").contains(f"/{STAGING}/"))
    held = parse_frame_path(files.select("path")).select("scene_id", "frame_id", F.element_at(F.split("path", "/"), -2).alias("camera"))
    return df.join(held, list(S.FRAME_KEYS), "left_anti")


def write_sidecars(df: DataFrame, root: str) -> None:
    """Write ``pooled`` of every candidate (frame keys, ``cand_idx`` from 0, ``pooled``) as half precision files.

    Frames that the tree already holds are skipped, so a job that was interrupted
    goes on where it stopped. Frames appear together when the job succeeds.
    """
    df.sparkSession.dataSource.register(FrameSidecars)
    rows = df.select(
        *[F.col(k).cast("int") if k != "camera" else F.col(k) for k in S.FRAME_KEYS],
        F.col(S.CANDIDATE).cast("long").alias(S.CANDIDATE),
        F.col("pooled").cast("array<float>").alias("pooled"),
    )
    rows = missing_frames_of(rows, root).repartition(*S.FRAME_KEYS).sortWithinPartitions(*S.FRAME_KEYS, S.CANDIDATE)
    rows.write.format(FORMAT).mode("append").save(root)

