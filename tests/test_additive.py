"""Additive models of several groups against least squares on indicators, group by group."""

import numpy as np
from pyspark.sql import functions as F

from copresence.operators import models


def rows(seed, g, n, crossed):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 4, n), rng.integers(0, 3, n), rng.integers(0, 5, n)
    y = 2.0 * a - b + (3.0 * ((a > 1) == (b > 1)) if crossed else 0) + 0.1 * rng.normal(size=n)
    return [(g, float(x), float(p), float(q), float(v)) for x, p, q, v in zip(a, b, c, y)]


def test_equals_least_squares(spark):
    data = rows(1, "u", 900, False) + rows(2, "v", 300, True) + [("w", 1.0, 1.0, 1.0, 5.0), ("u", None, 1.0, 1.0, 9.0)]
    df = spark.createDataFrame(data, "g string, a double, b double, c double, y double")
    got = models.additive_by_group(df, ["g"], ["a", "b", "c"], "y", bins=30, pairs=1).collect()
    single = {(r.g, r.feature, r.bin): r.effect for r in got if r.bin2 is None}
    for g in ("u", "v"):
        own = np.array([r[1:] for r in data if r[0] == g and r[1] is not None])
        place = [np.unique(own[:, i], return_inverse=True)[1] for i in range(3)]
        x = np.column_stack([np.ones(len(own))] + [(p == v).astype(float) for p in place for v in range(p.max() + 1)])
        beta = np.linalg.lstsq(x, own[:, 3], rcond=None)[0]
        at = 1
        for name, p in zip("abc", place):
            part = beta[at:at + p.max() + 1]
            at += p.max() + 1
            part = part - part[p].mean()
            assert np.allclose([single[g, name, v] for v in range(p.max() + 1)], part, atol=1e-8)
    best = {r.g: r.feature for r in got if r.bin2 is not None}
    assert best["v"] == "a x b" and set(best) == {"u", "v", "w"}
    weight = {(r.g, r.feature): r.importance for r in got}
    assert weight["u", "a"] > 1 > 0.1 > weight["u", "c"] and weight["v", "a x b"] > 0.5 > weight["u", best["u"]]
    assert {r.effect for r in got if r.g == "w"} == {0.0} or max(abs(r.effect) for r in got if r.g == "w") < 1e-9


def test_shares_add_up(spark):
    df = spark.createDataFrame(rows(3, "u", 500, True), "g string, a double, b double, c double, y double")
    out = models.additive_by_group(df, ["g"], ["a", "b", "c"], "y", bins=4, pairs=2)
    assert all(abs(r.s - 1) < 1e-9 for r in out.groupBy("feature").agg(F.sum("share").alias("s")).collect()) and out.select("feature").distinct().count() == 5
