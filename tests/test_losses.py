"""Object loss of rows of any shape, and its cost for many classes."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rankforge.functions.stats import multitask_loss

NAN, INF = float("nan"), float("inf")
OTHERS = {"pred": 0.0, "target": 0.0, "collision_logit": 0.0, "is_collision": False, "empty_logit": 0.0, "is_empty": False}


def losses(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, object_logits array<double>, object_id int")
    df = df.withColumns({n: F.lit(v) for n, v in OTHERS.items()})
    return {r["i"]: (r["loss_obj"], r["obj_acc_top1"]) for r in multitask_loss(df.coalesce(1), by=["i"]).collect()}


def test_object_terms_of_odd_rows(spark):
    out = losses(spark, [([1.0, 3.0, 3.0], 1), ([1.0, 3.0, 3.0], 2), ([5.0], 0), ([1.0, 2.0], -1), ([1.0, 2.0], None), (None, 0), ([], 0), ([2.0, None], 0)])
    nll = 3 + math.log(math.exp(-2) + 2) - 3
    assert out[0] == (pytest.approx(nll), 1.0) and out[1] == (pytest.approx(nll), 0.0) and out[2] == (0.0, 1.0)
    assert [out[i] for i in (3, 4, 5, 6)] == [(None, None)] * 4
    assert out[7] == (None, 1.0)


def test_object_terms_of_values_without_size(spark):
    out = losses(spark, [([1.0, NAN], 1), ([INF, 0.0], 0)])
    assert math.isnan(out[0][0]) and out[0][1] == 1.0
    assert math.isnan(out[1][0]) and out[1][1] == 1.0


def test_logits_are_built_once(spark):
    """The maximum of a row was computed again for each of its logits, which were built from their parts each time."""
    logits = F.array(*[F.col("id") * 0.001 * i for i in range(88)])
    df = spark.range(1000).withColumns({"object_logits": logits, "object_id": F.lit(3), **{n: F.lit(v) for n, v in OTHERS.items()}})
    out = multitask_loss(df)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first()["num_samples"] == 1000
