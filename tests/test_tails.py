"""Tail probabilities against known values and plain integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from copresence.functions import tails


def t_tail(t, df):
    """Simpson's rule after a tangent substitution, on a grid fine enough for many degrees of freedom."""
    k = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    lo = math.atan(t / math.sqrt(df))
    theta = np.linspace(lo, min(math.pi / 2, lo + 60 / math.sqrt(df)), 400_001)
    f = np.cos(theta) ** (df - 1)
    return k * (theta[1] - theta[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())


def test_normal(spark):
    z = [-50.0, -38.0, -8.0, -2.5, -1.0, -0.1, 0.0, 1e-9, 0.3, 1.0, 2.0, 2.4999, 2.5, 2.5001, 3.0, 5.0, 8.0, 20.0, 37.0, 50.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(tails.normal_tail(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(v / math.sqrt(2)) / 2 for v in z], rel=1e-11, abs=1e-300)


def test_student(spark):
    cases = [(t, df) for t in (-4.0, -0.5, 0.0, 0.01, 0.7, 1.5, 2.2, 5.0, 9.0) for df in (1, 2, 3, 5, 10, 47, 300, 20_000, 1_000_000)]
    got = spark.createDataFrame(cases, "t double, df int").select(tails.t_tail(F.col("t"), F.col("df"))).collect()
    assert [r[0] for r in got] == pytest.approx([t_tail(t, df) for t, df in cases], rel=1e-6, abs=1e-9)


def test_edges(spark):
    rows = [(None, 5), (float("nan"), 5), (1.0, 0), (float("inf"), 5), (float("-inf"), 5), (1.0, 1)]
    df = spark.createDataFrame(rows, "t double, df int")
    assert [r[0] for r in df.select(F.round(tails.t_tail(F.col("t"), F.col("df")), 9)).collect()] == [None, None, None, 0.0, 1.0, 0.25]
    assert [r[0] for r in df.select(F.round(tails.normal_tail(F.col("t")), 9)).collect()] == [None, None, 0.158655254, 0.0, 1.0, 0.158655254]


def test_log_gamma(spark):
    x = [0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 12345.5, 1e6]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(tails.log_gamma(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_arrays_of_numbers():
    z = np.array([-50.0, -38.0, -8.0, -2.5, -0.1, 0.0, 1e-9, 0.3, 2.4999, 2.5, 3.0, 8.0, 37.0, 50.0])
    assert tails.normal_tail_of(z) == pytest.approx([math.erfc(v / math.sqrt(2)) / 2 for v in z], rel=1e-11, abs=1e-300)
    cases = np.array([(t, df) for t in (-4.0, -0.5, 0.0, 0.7, 2.2, 9.0) for df in (1, 2, 5, 47, 300, 20_000)])
    assert tails.t_tail_of(cases[:, 0], cases[:, 1]) == pytest.approx([t_tail(t, df) for t, df in cases], rel=1e-6, abs=1e-9)
    t, df = np.array([np.nan, 1.0, np.inf, -np.inf, 1.0]), np.array([5, 0, 5, 5, 1])
    assert tails.t_tail_of(t, df) == pytest.approx([np.nan, np.nan, 0.0, 1.0, 0.25], nan_ok=True)
    assert tails.normal_tail_of(t) == pytest.approx([np.nan, 0.158655254, 0.0, 1.0, 0.158655254], nan_ok=True, abs=1e-9) and tails.normal_tail_of(z[:0]).size == 0
