"""Frames split over triggers, and compaction of ingested batches."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators.scoring import rerank
from rankforge.session import names_in, publish
from rankforge.streaming import jobs as J
from tests.conftest import as_set

SCHEMA = "scene_id int, frame_id int, camera string, cand_idx long, base_score double, model_score double, num long"


def candidates(frame, idx, num, camera="a"):
    return [(1, frame, camera, i, float(i * 7 % 5), float(i * 3 % 4), num) for i in idx]


class Arrivals:
    """A stream of files with one trigger per call."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root

    def add(self, rows, expected="num"):
        self.spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{self.root}/in")
        self.run(expected)

    def run(self, expected="num"):
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.root}/in")
        J.rerank_batches(stream, 0.5, f"{self.root}/out", f"{self.root}/check", expected=expected).awaitTermination()

    def ranked(self):
        return self.spark.read.parquet(f"{self.root}/out/batch=*")


def test_frame_over_three_triggers(spark, tmp_path):
    a = Arrivals(spark, str(tmp_path))
    a.add(candidates(1, range(0, 4), 10) + candidates(2, range(3), 3) + candidates(4, range(2), 4, None))
    assert {r["frame_id"] for r in a.ranked().collect()} == {2}
    assert as_set(J.held_frames(spark, f"{tmp_path}/out"), "frame_id", "num", "expected") == [(1, 4, 10), (4, 2, 4)]
    a.add(candidates(1, range(4, 6), 10))
    a.add(candidates(1, range(6, 10), 10) + candidates(3, range(1), 1) + candidates(4, range(2, 4), 4, None))
    whole = candidates(1, range(10), 10) + candidates(2, range(3), 3) + candidates(3, range(1), 1) + candidates(4, range(4), 4, None)
    want = rerank(spark.createDataFrame(whole, SCHEMA), 0.5)
    cols = ["frame_id", "cand_idx", "fused", "rank"]
    assert as_set(a.ranked(), *cols) == as_set(want, *cols)
    assert J.held_frames(spark, f"{tmp_path}/out").count() == 0
    assert names_in(spark, f"{tmp_path}/out/_arrived") == []
    a.run()
    assert a.ranked().count() == len(whole)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    a = Arrivals(spark, str(tmp_path))
    a.add(candidates(1, range(2), 4))
    a.add(candidates(1, range(2, 4), 4) + candidates(2, range(1), 2))
    before = as_set(a.ranked(), "frame_id", "cand_idx", "rank")
    # As after a crash: results are written, the commit of the batch is not.
    for name in ("1", ".1.crc"):
        os.remove(tmp_path / "check" / "commits" / name)
    a.run()
    assert as_set(a.ranked(), "frame_id", "cand_idx", "rank") == before
    assert as_set(J.held_frames(spark, f"{tmp_path}/out"), "frame_id", "num") == [(2, 1)]


@pytest.mark.parametrize(
    "second, expected, message",
    [
        (candidates(1, range(2, 5), 4), "num", "recorded number of frame 1 1"),
        (candidates(1, range(2, 3), 5), "num", "recorded number"),
        (candidates(1, range(2, 3), None), "num", "recorded number"),
        (candidates(2, range(2, 3), 3), "num", "ranked already"),
        (candidates(2, range(2, 3), 3), None, "ranked already"),
    ],
)
def test_late_and_surplus_rows(spark, tmp_path, second, expected, message):
    a = Arrivals(spark, str(tmp_path))
    a.add(candidates(2, range(2), 2) + (candidates(1, range(2), 4) if expected else []), expected)
    before = a.ranked().count()
    with pytest.raises(Exception, match=message):
        a.add(second, expected)
    assert a.ranked().count() == before


class Dumps:
    def __init__(self, spark, root):
        self.spark, self.root, self.out = spark, root, f"{root}/out"

    def ingest(self, *frames, flat=False):
        for scene, frame, score in frames:
            folder = self.root / "in" / f"scene_{scene:04d}" / ("." if flat else "cam")
            folder.mkdir(parents=True, exist_ok=True)
            m = np.zeros((2, 17), np.float32)
            m[:, 0] = score
            np.save(folder / f"{frame:04d}.npy", m)
        J.stream_ingest(self.spark, str(self.root / "in"), self.out, f"{self.root}/check", "cam", "*.npy").awaitTermination()

    def scores(self):
        return as_set(J.latest_ingested(self.spark, self.out), "scene_id", "frame_id", "cand_idx", "base_score")

    def merge(self):
        before = self.scores()
        done = J.compact_ingested(self.spark, self.out)
        assert self.scores() == before
        return done


def rows(*frames):
    return sorted((s, f, i, float(x)) for s, f, x in frames for i in (0, 1))


def test_compaction_keeps_the_chosen_layout(spark, tmp_path):
    d = Dumps(spark, tmp_path)
    first = [(1, f, f) for f in range(8)]
    d.ingest(*first, flat=True)
    assert d.merge() and not d.merge()
    d.ingest((1, 0, 90), (2, 0, 91))  # overrules a merged flat file
    want = rows((1, 0, 90), (2, 0, 91), *first[1:])
    assert d.scores() == want
    assert d.merge() and d.scores() == want
    assert len(J._last_commit(spark, d.out)[1]["segments"]) == 2
    d.ingest((2, 0, 5), flat=True)  # loses against the merged camera file
    assert d.scores() == want and d.merge() and d.scores() == want
    d.ingest((1, 1, 92), (3, 0, 93))
    want = rows((1, 0, 90), (1, 1, 92), (2, 0, 91), (3, 0, 93), *first[2:])
    assert d.merge() and d.scores() == want
    # Only the batches of the last merge are left beside the segments.
    assert len([n for n in names_in(spark, d.out) if n.startswith("batch=")]) == 1


def test_merged_table_is_read_without_grouping(spark, tmp_path):
    d = Dumps(spark, tmp_path)
    for f in range(6):
        d.ingest((1, f, f))
        d.merge()
    plan = J.latest_ingested(spark, d.out)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert len(J._last_commit(spark, d.out)[1]["segments"]) <= 3


def test_lost_and_overtaken_runs(spark, tmp_path, monkeypatch):
    d = Dumps(spark, tmp_path)
    d.ingest((1, 0, 1))

    def crash(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(J, "publish", crash)
        with pytest.raises(RuntimeError, match="lost"):
            J.compact_ingested(spark, d.out)
    assert d.scores() == rows((1, 0, 1))
    with monkeypatch.context() as m:
        m.setattr(J, "publish", lambda *a: False)
        assert not J.compact_ingested(spark, d.out)
    assert len(names_in(spark, f"{d.out}/_segments")) == 1
    assert d.merge() and d.scores() == rows((1, 0, 1))
    assert not publish(spark, f"{d.out}/_commits/00000000.json", "{}")
