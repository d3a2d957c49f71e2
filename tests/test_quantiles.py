"""Exact quantiles against sorting, on values that no counter per distinct value should hold."""

import random
from math import nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.operators.quantiles import exact_quantiles, ranked

SHARES = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]


def test_distinct_doubles(spark):
    df = spark.range(200_000, numPartitions=8).select((F.randn(3) * F.exp(F.rand(4) * 40)).alias("x")).cache()
    want = np.quantile(df.toPandas()["x"].to_numpy(), SHARES)
    assert exact_quantiles(df, "x", SHARES, few=500) == pytest.approx(want.tolist(), rel=1e-12)
    df.unpersist()


@pytest.mark.parametrize("make", (lambda r: r.choice((0.0, 1.0)), lambda r: 5.0, lambda r: r.choice((0.0, 0.0, 0.0, r.random() * 1e300)), lambda r: float(r.randrange(9))))
def test_ties(spark, make):
    rnd = random.Random(5)
    values = [make(rnd) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, nan]], "x double").cache()
    in_order = sorted(values)
    ranks = (0, 7, 1499, 1500, 2998, 2999)
    assert ranked(df, "x", (*ranks, 3000, -1), few=10) == {k: in_order[k] for k in ranks}
    df.unpersist()


def test_nothing_and_integers(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
    assert exact_quantiles(spark.createDataFrame([], "x long"), "x", [0.1, 0.9]) == [None, None]
    assert exact_quantiles(spark.createDataFrame([(4,), (1,), (2,)], "x int"), "x", [0.5, 0.75]) == [2.0, 3.0]
