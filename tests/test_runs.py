"""Runs of ids against a plain loop, across the edges of batches and of ranges, and their shuffles."""

from __future__ import annotations

import numpy as np
import pytest

from rankforge.operators.splits import contiguous_runs


def expected(rows):
    """``rows`` of (key, sequence, id)."""
    out, seen = [], {}
    for key, _, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        runs = seen.setdefault(key, [])
        if runs and i is not None and runs[-1][-1] is not None and i == runs[-1][-1] + 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    for key, runs in seen.items():
        at = 0
        for run in runs:
            out.append((key, run[0], len(run), at))
            at += len(run)
    return sorted(out, key=str)


def rows_of(kind):
    rng = np.random.default_rng(4)
    if kind == "one long run":
        return [(1, s, s + 5) for s in range(900)]
    if kind == "long runs and a break":
        return [(s // 400, s, s if s != 150 else 10_000) for s in range(900)]
    if kind == "small groups":
        return [(int(rng.integers(150)), s, s // 3) for s in range(900)]
    return [(None if s % 5 == 0 else int(rng.integers(3)), s, None if s % 41 == 0 else int(s + rng.integers(0, 2))) for s in range(900)]


@pytest.mark.parametrize("batch", ["7", "10000"])
@pytest.mark.parametrize("kind", ["one long run", "long runs and a break", "small groups", "nulls"])
def test_runs_equal_a_loop(spark, kind, batch):
    rows = rows_of(kind)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "k int, seq long, idx long").repartition(5)
        found = sorted(((r.k, r.start, r["length"], r.position) for r in contiguous_runs(df, "idx", order="seq", keys=["k"]).collect()), key=str)
        assert found == expected(rows)
        whole = contiguous_runs(df.drop("k"), "idx", order="seq").collect()
        assert sorted(((None, r.start, r["length"], r.position) for r in whole), key=str) == expected([(None, s, i) for _, s, i in rows])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_stay_out_of_joins_and_windows(spark, monkeypatch):
    """The rows themselves were joined with the rows before them and ran through windows; now only pieces are written."""
    import rankforge.operators.splits as splits

    plans, write = [], splits.materialise
    monkeypatch.setattr(splits, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS seq", "id div 2 AS idx")
    assert sorted(tuple(r) for r in contiguous_runs(df, "idx", order="seq", keys=["k"]).collect()) == [(0, 0, 500, 0), (1, 0, 500, 0)]
    assert "MapInArrow" in plans[0] and "Window" not in plans[0] and "Join" not in plans[0]
