"""Exact median between approximate quantiles vs numpy, with a low accuracy so that
several passes run."""

import random

import numpy as np
import pytest

from dialogscope.operators import quantile
from dialogscope.operators.quantile import exact_kth, exact_median


@pytest.mark.parametrize("n,seed", [(1, 0), (2, 1), (101, 2), (1000, 3), (2500, 4)])
def test_median_matches_numpy(spark, n, seed):
    rnd = random.Random(seed)
    vals = [round(rnd.lognormvariate(5, 2), 2) if rnd.random() > 0.2 else float(rnd.randint(0, 5))
            for _ in range(n)]
    rows = [(v,) for v in vals] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double")
    got = exact_median(df, "x", accuracy=50, small=8)
    assert got == pytest.approx(float(np.median(vals)), rel=1e-12, abs=1e-12)


def test_kth_every_rank_small(spark):
    vals = [3.0, -1.0, 3.0, 7.5, 1e300, -1e300, 0.0, 0.0, 2.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    ordered = sorted(vals)
    for k in range(len(vals)):
        assert exact_kth(df, "x", k, accuracy=50, small=1) == ordered[k]


def test_empty_and_constant(spark):
    assert exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None
    df = spark.createDataFrame([(4.25,)] * 10, "x double")
    assert exact_median(df, "x", accuracy=50, small=1) == 4.25


def test_infinities(spark):
    vals = [float("-inf"), 1.0, 2.0, 3.0, float("inf"), float("inf"), 5.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    ordered = sorted(vals)
    for k in range(len(vals)):
        assert exact_kth(df, "x", k, accuracy=50, small=1) == ordered[k]
    assert exact_median(df, "x", accuracy=50, small=1) == float(np.median(vals))
    assert exact_median(spark.createDataFrame([(float("inf"),), (1.0,)], "x double"), "x") == float("inf")


def test_few_passes_for_any_spread(spark, monkeypatch):
    """Values over a hundred orders of magnitude: the number of passes follows the number of rows, not their spread."""
    passes, around = [], quantile._around
    monkeypatch.setattr(quantile, "_around", lambda *a: passes.append(1) or around(*a))
    vals = np.exp(np.random.default_rng(5).normal(0, 60, 50_000))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    assert exact_median(df, "x", accuracy=1000, small=500) == pytest.approx(float(np.median(vals)), rel=1e-12)
    assert 1 <= len(passes) <= 2
