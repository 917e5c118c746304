"""Quantiles of large groups and rows behind the first ones of a group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rankforge.plans import groups as G
from tests.conftest import as_set


def test_slices_hold_the_order_statistics(spark):
    rng = np.random.default_rng(2)
    values = {
        None: rng.normal(size=301),
        1: rng.integers(0, 3, 200).astype(float),
        2: np.full(50, 7.0),
        3: np.append(rng.normal(size=90), [np.inf, -np.inf, 1e308, -1e308]),
        4: np.array([5.0, 6.0]),
    }
    rows = [(k, float(x)) for k, v in values.items() for x in v]
    df = spark.createDataFrame(rows, "g int, x double")
    quantiles = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.95, "q4": 1.0}
    large = G.exact_quantiles(df, ["g"], F.col("x"), quantiles, limit=1)
    got = {r["g"]: tuple(r)[1:] for r in large.collect()}
    assert set(got) == set(values)
    for g, v in values.items():
        at = np.sort(v)
        for value, q in zip(got[g], quantiles.values()):
            place = q * (len(at) - 1)
            low, high = at[int(np.floor(place))], at[int(np.ceil(place))]
            want = low + (high - low) * (place - np.floor(place)) if high != low else low
            assert value == want or np.isclose(value, want, rtol=1e-12) or (np.isnan(value) and (np.isnan(want) or np.isinf(low)))


def test_few_rows_are_counted_by_value(spark, monkeypatch):
    """Only the slices around the wanted places reach the running totals."""
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    seen, scan = [], G.scan_within
    monkeypatch.setattr(G, "scan_within", lambda rows, *a, **k: seen.append(rows.count()) or scan(rows, *a, **k))
    assert as_set(G.exact_quantiles(df, ["g"], F.col("x"), {"m": 0.5}, limit=1000)) == [(1, 9999.5)]
    assert sum(seen) < 100


def test_beyond_first(spark):
    df = spark.createDataFrame([(g, i // 3, i) for g in (1, 2, None) for i in range(4 if g == 2 else 20)], "g int, o int, v int")
    for n in (0, 4, 5, 30):
        out = G.beyond_first(df, ["g"], ["o"], n)
        assert sorted(map(str, out.groupBy("g").count().collect())) == sorted(
            f"Row(g={g}, count={size - n})" for g, size in ((1, 20), (2, 4), (None, 20)) if size > n
        )
        assert out.distinct().count() == out.count()
        # Whole places before the n-th row are gone, whole places behind it are there.
        assert out.where(f"g = 1 AND o < {n // 3}").count() == 0
