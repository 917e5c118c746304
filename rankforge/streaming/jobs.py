"""Streams of dumps, frames and candidates."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankforge import schemas as S
from rankforge.functions.expressions import check_weight, success_label
from rankforge.operators.scoring import rerank
from rankforge.session import names_in, publish, remove
from rankforge.sources.catalog import dedupe_layouts, parse_frame_path
from rankforge.sources.dumps import decode_dump_rows

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Bytes that opening a file counts as when files are packed into tasks, and the least number of tasks.
OPENING, LEAST_TASKS = "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"


def _moments(values: Column) -> Column:
    """Mean and population std of a numeric array in one pass (running moments)."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1.0
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + (x - acc["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(
        values,
        start,
        step,
        lambda acc: F.struct(
            acc["mean"].alias("mean"), F.sqrt(acc["m2"] / F.greatest(acc["n"], F.lit(1.0))).alias("std")
        ),
    )


def _scaled(values: str, moments: str) -> Column:
    mean, std = F.col(moments)["mean"], F.col(moments)["std"]
    return F.transform(values, lambda x: F.when(std <= S.STD_FLOOR, F.lit(0.0)).otherwise((x - mean) / std))


def stream_rerank(
    frames: DataFrame,
    lam: float,
    scores: Column | None = None,
    candidates: str = "candidates",
) -> DataFrame:
    """Re-rank arriving frames; also works on a batch table.

    One record is one frame: an array of ``struct(cand_idx, base_score, ...)``.
    ``scores`` is an array of model scores in the same order (default: field
    ``model_score``). Ranking inside the record keeps the stream stateless.
    """
    lam = check_weight(lam)
    kept = [c for c in frames.columns if c != candidates]
    c = F.col(candidates)
    model = scores if scores is not None else F.transform(c, lambda x: x["model_score"].cast("double"))
    base = F.transform(c, lambda x: x["base_score"].cast("double"))
    staged = frames.select(*kept, c.alias("_c"), base.alias("_base"), model.alias("_model"))
    # Moments are columns of their own, so they are computed once per record.
    staged = staged.withColumns({"_bm": _moments(F.col("_base")), "_mm": _moments(F.col("_model"))})
    staged = staged.withColumns({"_bz": _scaled("_base", "_bm"), "_mz": _scaled("_model", "_mm")})
    fused = F.zip_with("_bz", "_mz", lambda b, m: F.lit(1.0 - lam) * b + F.lit(lam) * m)
    entries = F.zip_with(
        "_c",
        F.col("_f"),
        lambda x, f: F.struct((-f).alias("_neg"), x["cand_idx"].alias("_idx"), x.alias("c"), f.alias("fused")),
    )
    return (
        staged.withColumn("_f", fused)
        .select(*kept, F.posexplode(F.array_sort(entries)).alias("_pos", "_e"))
        .select(*kept, "_e.c.*", "_e.fused", (F.col("_pos") + 1).cast("long").alias("rank"))
    )


def _held(rows: DataFrame, frames: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows whose frame is (``left_semi``) or is not (``left_anti``) listed; null keys are keys too."""
    listed = frames.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(listed, reduce(lambda a, b: a & b, same), how)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that are completely written below ``folder``, ascending."""
    found = [n for n in names_in(spark, folder) if n.startswith("batch=")]
    return sorted(int(n[6:]) for n in found if "_SUCCESS" in names_in(spark, f"{folder}/{n}"))


def rerank_batches(
    candidates: DataFrame,
    lam: float,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = S.FRAME_KEYS,
    expected: str | None = None,
    per_trigger_check: bool = True,
) -> StreamingQuery:
    """Re-rank candidate rows as they arrive, for frames too large for one record.

    ``expected`` names a column with the recorded number of candidates of the
    row's frame. A frame is then held until that many rows have arrived, over any
    number of triggers, and ranked once by the batch operator, which splits large
    frames. Held rows are a written table (``out/_held``), not the state of one
    task, so that a frame may be of any size. More rows than recorded, two records
    for one frame, a missing record, and rows of a frame that is ranked already
    are errors, and then nothing of the batch is written. Without ``expected`` a
    frame must arrive in one trigger, and a later row of it is an error
    (``per_trigger_check=False`` leaves that out for streams that only ever see
    new frames). ``held_frames`` lists what is still incomplete.

    Everything is written under the number of the batch and derived from what the
    batch before has left, so a repeated batch replaces itself.
    """
    keys = list(keys)

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _numbers(spark, f"{out}/_held") if n < number]
        done = [n for n in _numbers(spark, f"{out}/_frames") if n < number]
        arrived, frames = f"{out}/_arrived/batch={number}", f"{out}/_frames/batch={number}"
        rows = batch
        if before:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{out}/_held/batch={before[-1]}"))
        rows.write.mode("overwrite").parquet(arrived)
        rows = spark.read.schema(batch.schema).parquet(arrived)
        record = F.col(expected).cast("long") if expected else F.lit(None).cast("long")
        total = F.count(F.lit(1))
        counts = rows.groupBy(*keys).agg(
            total.alias("num"), F.min(record).alias("expected"), F.max(record).alias("_most"), F.count(record).alias("_recorded")
        )
        if expected:
            wrong = (F.col("num") > F.col("expected")) | (F.col("expected") != F.col("_most")) | (F.col("_recorded") < F.col("num"))
            complete = F.col("num") == F.col("expected")
        else:
            wrong, complete = F.lit(False), F.lit(True)
        found = F.concat(*[c for k in keys for c in (F.coalesce(F.col(k).cast("string"), F.lit("null")), F.lit(" "))])
        report = F.concat(F.lit("rows differ from the recorded number of frame "), found, F.lit("with "), F.col("num").cast("string"), F.lit(" rows"))
        right = F.when(wrong, F.raise_error(report).cast("boolean")).otherwise(F.lit(True))
        counts.where(right).select(*keys, "num", "expected", complete.alias("complete")).write.mode("overwrite").parquet(frames)
        listed = spark.read.parquet(frames)
        if done and per_trigger_check:
            earlier = spark.read.parquet(*[f"{out}/_frames/batch={n}" for n in done]).where("complete")
            late = _held(listed, earlier, keys, "left_semi").limit(10).collect()
            if late:
                remove(spark, frames)
                raise ValueError(f"rows of frames that are ranked already: {[r.asDict() for r in late]}")
        whole = listed.where("complete")
        rerank(_held(rows, whole, keys, "left_semi"), lam, keys=keys).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if expected:
            _held(rows, whole, keys, "left_anti").write.mode("overwrite").parquet(f"{out}/_held/batch={number}")
        remove(spark, arrived)
        # A repeated batch needs what the one before it has left, and nothing older.
        for n in before[:-1]:
            remove(spark, f"{out}/_held/batch={n}")

    return (
        candidates.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def held_frames(spark: SparkSession, out: str) -> DataFrame | None:
    """Frames of ``rerank_batches`` that wait for rows: keys, rows so far, recorded number. None before the first batch."""
    numbers = _numbers(spark, f"{out}/_frames")
    return spark.read.parquet(f"{out}/_frames/batch={numbers[-1]}").where("NOT complete").drop("complete") if numbers else None


def _listing_session(spark: SparkSession) -> SparkSession:
    """A session of the same settings for streams of many files: each batch lists its paths
    again, by default with a task per path, and reads 32 small files in a task. Here it
    lists by a few tasks per core and reads up to 512 files in one, unless the user has set it."""
    own, few = spark.newSession(), spark.sparkContext.defaultParallelism * 4
    for key, value in ((LISTING, few), (LEAST_TASKS, few), (OPENING, 1 << 18)):
        own.conf.set(key, value)
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def stream_ingest(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    camera: str,
    glob: str = "*.npy",
    per_trigger: int | None = None,
) -> StreamingQuery:
    """Ingest dumps that are new since the last run, each exactly once, then stop.

    Paths without scene or frame and files of other cameras are left out. Every
    micro-batch chooses one layout per frame and writes under its own number, so
    a repeated batch replaces itself; where
    the layouts of a frame arrive in different batches, ``latest_ingested``
    shows the camera layout only. ``compact_ingested`` merges the batches.
    """
    reader = (
        _listing_session(spark).readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
    )
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)

    def save(batch: DataFrame, number: int) -> None:
        files = parse_frame_path(batch)
        chosen = dedupe_layouts(batch.select("path"), camera=camera).select("path")
        rows = decode_dump_rows(files.join(chosen, "path", "left_semi"), camera)
        rows.withColumn("flat", ~F.col("path").rlike(f"/{camera}/[^/]+$")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        reader.load(root)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


_FRAME = ["scene_id", "frame_id", "camera"]
# Segments of less than this many times the rows of a newer one are merged into it.
TIER = 4


def _last_commit(spark: SparkSession, out: str) -> tuple[int, dict]:
    """Number and content of the newest commit of a compacted table."""
    numbers = [n for n in names_in(spark, f"{out}/_commits") if n.endswith(".json")]
    if not numbers:
        return -1, {"upto": -1, "segments": []}
    text = spark.read.text(f"{out}/_commits/{numbers[-1]}", wholetext=True).first()[0]
    return int(numbers[-1].removesuffix(".json")), json.loads(text)


def _fresh_batches(spark: SparkSession, out: str, commit: dict) -> DataFrame | None:
    numbers = [n for n in _numbers(spark, out) if n > commit["upto"]]
    return spark.read.parquet(*[f"{out}/batch={n}" for n in numbers]) if numbers else None


def _segments(spark: SparkSession, out: str, names: Sequence[str], part: str) -> DataFrame | None:
    return spark.read.parquet(*[f"{out}/_segments/{n}/{part}" for n in names]) if names else None


def _one_layout(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of each frame's chosen file, and those files: camera layout first, then the smallest path."""
    files = rows.groupBy(*_FRAME, "path").agg(F.min("flat").alias("flat"))
    best = files.groupBy(*_FRAME).agg(F.min(F.struct("flat", "path")).alias("_b")).select(*_FRAME, "_b.*")
    return rows.join(best.select("path"), "path", "left_semi"), best


def _overruled(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of two lists of chosen files: the old ones that lose against a new one, and the new ones that lose."""
    rival = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(_FRAME)], F.struct("flat", "path").alias("_rival"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(_FRAME)]
    both = old.join(rival, reduce(lambda a, b: a & b, same))
    mine = F.struct("flat", "path")
    return both.where(mine > F.col("_rival")).select("path"), both.where(mine < F.col("_rival")).select(F.col("_rival.path").alias("path"))


def latest_ingested(spark: SparkSession, out: str) -> DataFrame:
    """Candidates of all ingested batches, each frame in its camera layout if that has arrived.

    What ``compact_ingested`` has merged is read as it stands; a layout is chosen
    only among the files of later batches and the list of merged files, and merged
    rows are left out only for files that were overruled.
    """
    _, commit = _last_commit(spark, out)
    names = [s["name"] for s in commit["segments"]]
    fresh, merged = _fresh_batches(spark, out, commit), _segments(spark, out, names, "rows")
    if merged is None:
        return _one_layout(spark.read.parquet(f"{out}/batch=*") if fresh is None else fresh)[0].drop("flat")
    gone = _segments(spark, out, names, "gone").select("path")
    if fresh is None:
        return merged.join(gone, "path", "left_anti").drop("flat")
    rows, best = _one_layout(fresh)
    files = _segments(spark, out, names, "files").join(gone, "path", "left_anti")
    old_gone, new_gone = _overruled(files, best)
    kept = merged.join(gone.union(old_gone), "path", "left_anti")
    return kept.unionByName(rows.join(new_gone, "path", "left_anti")).drop("flat")


def compact_ingested(spark: SparkSession, out: str, min_batches: int = 1) -> bool:
    """Merge the ingested batches that are not merged yet; False where nothing was to do.

    A segment holds the chosen rows of its batches (``rows``), the list of their
    files (``files``) and the files of older segments that they overrule
    (``gone``). Older segments that are not ``TIER`` times as large are merged
    along, so that there are only as many as the logarithm of the table and a row
    is rewritten that often. A segment counts once its commit file appears; a run
    that is lost before leaves a folder that nobody reads, and one that another
    run has overtaken deletes its own. Batches and segments that the commit before
    the last replaced are deleted, hence readers may be one compaction late.
    """
    number, commit = _last_commit(spark, out)
    fresh_numbers = [n for n in _numbers(spark, out) if n > commit["upto"]]
    if len(fresh_numbers) < max(min_batches, 1):
        return False
    fresh, kept = _fresh_batches(spark, out, commit), list(commit["segments"])
    size, folded = fresh.count(), []
    while kept and kept[-1]["rows"] < TIER * size:
        folded.insert(0, kept.pop())
        size += folded[0]["rows"]
    names, old = [s["name"] for s in folded], [s["name"] for s in kept]
    rows = fresh
    if folded:
        rows = rows.unionByName(_segments(spark, out, names, "rows"))
    everything = _segments(spark, out, [*old, *names], "gone")
    if everything is not None:
        everything = everything.select("path")
        rows = rows.join(everything, "path", "left_anti")
    rows, best = _one_layout(rows)
    name = uuid.uuid4().hex
    folder = f"{out}/_segments/{name}"
    gone = spark.createDataFrame([], "path string")
    if old:
        listed = _segments(spark, out, old, "files").join(everything, "path", "left_anti")
        lost, beaten = _overruled(listed, best)
        lost.write.parquet(f"{folder}/lost")
        beaten.write.parquet(f"{folder}/beaten")
        gone, beaten = spark.read.parquet(f"{folder}/lost"), spark.read.parquet(f"{folder}/beaten")
        rows, best = (df.join(beaten, "path", "left_anti") for df in (rows, best))
        # What folded segments overruled in the kept ones stays overruled.
        if names:
            gone = gone.union(_segments(spark, out, names, "gone").select("path"))
    rows.write.parquet(f"{folder}/rows")
    best.write.parquet(f"{folder}/files")
    gone.write.parquet(f"{folder}/gone")
    entry = {"name": name, "rows": spark.read.parquet(f"{folder}/rows").count()}
    content = {"upto": fresh_numbers[-1], "segments": [*kept, entry], "replaced": {"upto": commit["upto"], "segments": names}}
    if not publish(spark, f"{out}/_commits/{number + 1:08d}.json", json.dumps(content)):
        remove(spark, folder)
        return False
    before = commit.get("replaced", {"segments": []})
    for old_name in before["segments"]:
        remove(spark, f"{out}/_segments/{old_name}")
    for n in _numbers(spark, out):
        if n <= commit["upto"]:
            remove(spark, f"{out}/batch={n}")
    return True


def stream_manifest(
    candidates: DataFrame,
    time: str | None = None,
    window: str = "1 hour",
    delay: str = "10 minutes",
    scene: str = "scene_id",
    tau: float = S.SUCCESS_TAU,
) -> DataFrame:
    """Running label counts per scene, per event-time window when there is a time.

    Rows later than ``delay`` behind the newest are dropped once their window
    closed. NTZ times are read in the session time zone.
    """
    keys: list[Column | str] = [scene]
    rows = candidates
    if time:
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
        keys = [F.window(time, window).alias("window"), scene]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num"),
        F.count_if(success_label("mu_min", tau)).alias("success_count"),
        F.count_if("is_collision").alias("collision_count"),
        F.count_if("is_empty").alias("empty_count"),
    )


def write_updates(df: DataFrame, out: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every micro-batch of changed rows with its number; readers keep the latest."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def latest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest state of every key from the written updates."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, "_v.*")
