"""The joint fit against a dense solver, and the order it leads to against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.operators.training import feature_vector, fit_joint, score_joint
from rankforge.plans import pipelines
from suite import modelling as Q

SF = "/root/testdata/sf0.001"
W = S.LOSS_WEIGHTS


def dense(x, q, c, e, o, classes, ridge, steps=60):
    """Newton's method head by head on standardised features, rows in memory."""
    std = x.std(axis=0)
    z = np.column_stack([(x - x.mean(axis=0)) / np.where(std > 1e-9, std, 1), np.ones(len(x))])
    hold = ridge * np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros((z.shape[1], 3 + classes))
    tiny = 1e-12 * np.eye(z.shape[1])
    for _ in range(steps):
        d = z @ w[:, 0] - q
        g = z.T @ np.clip(d, -1, 1) / len(z) + hold @ w[:, 0]
        h = (z * (np.abs(d) < 1)[:, None]).T @ z / len(z) + hold
        w[:, 0] -= np.linalg.solve(h + 1e-6 * np.eye(len(h)), g)
        for at, y, share in ((1, c, W["collision"]), (2, e, W["empty"])):
            p = 1 / (1 + np.exp(-z @ w[:, at]))
            g = share * z.T @ (p - y) / len(z) + hold @ w[:, at]
            w[:, at] -= np.linalg.solve(share * (z * (p * (1 - p))[:, None]).T @ z / len(z) + hold + tiny, g)
        known = o >= 0
        u, k = z[known], known.sum()
        p = np.exp(u @ w[:, 3:])
        p /= p.sum(axis=1, keepdims=True)
        g = W["object"] * u.T @ (p - np.eye(classes)[o[known]]) / k + hold @ w[:, 3:]
        h = np.einsum("na,nb,ni,nij->aibj", u, u, p, np.eye(classes)[None] - p[:, None, :]) * W["object"] / k
        h = h.reshape(w[:, 3:].size, -1) + np.kron(hold, np.eye(classes))
        w[:, 3:] -= np.linalg.lstsq(h, g.ravel(), rcond=1e-12)[0].reshape(-1, classes)
    return w, z


def rows_of(spark, n=400, seed=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 1000, 0]
    x = np.column_stack([x, np.full(n, 7.0)])
    mu = np.where(r.random(n) < 0.2, np.inf, 0.4 + 0.2 * x[:, 0] + 0.1 * r.normal(size=n))
    c = r.random(n) < 1 / (1 + np.exp(-x[:, 0]))
    e = r.random(n) < 0.3
    o = np.where(r.random(n) < 0.2, -1, (r.random(n) * 3 + (x[:, 2] > 0)).astype(int) % 3)
    data = [(v.tolist(), float(m), bool(a), bool(b), int(k)) for v, m, a, b, k in zip(x, mu, c, e, o)]
    df = spark.createDataFrame(data, "features array<double>, mu_min double, is_collision boolean, is_empty boolean, object_id int")
    return df, (x, 0.4 - np.where(np.isfinite(mu), mu, 2.0), c.astype(float), e.astype(float), o)


def test_joint_fit_equals_dense_solver(spark):
    df, arrays = rows_of(spark)
    model = fit_joint(df.repartition(7), classes=3, ridge=1e-3, tol=1e-9)
    want, z = dense(*arrays, classes=3, ridge=1e-3)
    assert np.allclose(model.weights[:, :3], want[:, :3], atol=1e-5)
    # A shift of all classes alike changes no probability.
    assert np.allclose(model.weights[:, 3:] - model.weights[:, 3:].mean(axis=1, keepdims=True), want[:, 3:] - want[:, 3:].mean(axis=1, keepdims=True), atol=1e-5)
    assert all(a >= b - 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    scored = score_joint(df, model).collect()
    assert np.allclose([r["predicted_quality"] for r in scored], z @ model.weights[:, 0])
    assert {len(r["object_logits"]) for r in scored} == {3}


def test_many_partitions_give_the_same_model(spark):
    df, _ = rows_of(spark, 300)
    one, many = (fit_joint(df.repartition(n), classes=3, ridge=1e-2) for n in (1, 80))
    assert np.allclose(one.weights, many.weights, atol=1e-4)


def test_missing_targets_and_wrong_rows(spark):
    df, _ = rows_of(spark, 200)
    gaps = df.withColumns({"is_empty": F.lit(None).cast("boolean"), "object_id": F.lit(None).cast("int"), "mu_min": F.when(F.rand(3) < 0.5, F.col("mu_min"))})
    model = fit_joint(gaps, classes=3)
    assert np.abs(model.weights[:, 2:]).max() < 1e-6 and np.abs(model.weights[:, 0]).max() > 0.05
    with pytest.raises(ValueError, match="no rows"):
        fit_joint(df.limit(0))
    with pytest.raises(Exception, match="out of range"):
        fit_joint(df.withColumn("object_id", F.lit(3)), classes=3)
    with pytest.raises(Exception, match="finite numbers"):
        fit_joint(df.withColumn("features", F.when(F.col("is_empty"), F.array(F.lit(1.0))).otherwise(F.col("features"))), classes=3)
    with pytest.raises(RuntimeError, match="no minimum"):
        fit_joint(df, classes=3, max_passes=3)


def test_feature_vector_fills_missing_numbers(spark):
    df = spark.createDataFrame([([1.0, None], None, True)], "a array<double>, b double, c boolean")
    assert df.select(feature_vector(F.col("a"), "b", "c").alias("v")).first()["v"] == [1.0, 0.0, 0.0, 1.0]


def test_pipeline_equals_brute_force(spark):
    rows = Q.described(spark, SF)
    assert rows.count() == Q.M.candidates(spark, SF).count()
    model, got = pipelines.fit_and_compare(rows, F.expr(Q.TRAIN), 0.5, ridge=1e-2, tol=1e-4)
    frames = {}
    for r in rows.where(f"NOT ({Q.TRAIN})").select("scene_id", "frame_id", "cand_idx", "base_score", "mu_min", "features").collect():
        frames.setdefault((r["scene_id"], r["frame_id"]), []).append(r)
    total = []
    for rs in frames.values():
        rs.sort(key=lambda r: r["cand_idx"])
        z = lambda v: (v - v.mean()) / v.std() if v.std() > 1e-6 else 0 * v
        base = z(np.array([r["base_score"] for r in rs], float))
        fused = 0.5 * base + 0.5 * z(model.outputs(np.array([r["features"] for r in rs], float))[:, 0])
        order = np.argsort(-fused, kind="stable")[:50]
        mu = np.array([rs[i]["mu_min"] for i in order])
        for f in S.FRICTIONS:
            hits = np.cumsum(np.concatenate([(mu > 0) & (mu <= f), np.zeros(50 - len(mu), bool)]))
            total.append((hits / np.arange(1, 51)).mean())
    overall = [r["ap"] for r in got.where("`order` = 'fused' AND split = 'overall'").collect()]
    assert overall == [pytest.approx(100 * np.mean(total), abs=2e-4)]
