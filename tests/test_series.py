"""Tests of series against plain loops, published values and tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from copresence.operators import series


def t_tail(t, df):
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    k = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    theta = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 4001)
    f = np.cos(theta) ** (df - 1)
    return float(k * (theta[1] - theta[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()))


def rank_tail(d):
    """T+ and its tail: all sign patterns counted for small n, else the normal score."""
    left = [v for v in d if v != 0]
    size = sorted(abs(v) for v in left)
    rank = lambda v: (size.index(abs(v)) + 1 + len(size) - size[::-1].index(abs(v))) / 2
    plus, n = sum(rank(v) for v in left if v > 0), len(left)
    if not n:
        return 0.0, 1.0
    ties = sum(size.count(a) ** 2 - 1 for a in size)
    if n == len(d) and not ties and n <= 50:
        ways = {0: 1}
        for r in range(1, n + 1):
            now = dict(ways)
            for k, c in ways.items():
                now[k + r] = now.get(k + r, 0) + c
            ways = now
        return plus, sum(c for k, c in ways.items() if k >= plus) / 2 ** n
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return plus, math.erfc((plus - n * (n + 1) / 4) / math.sqrt(2 * var)) / 2 if var > 0 else None


def made():
    rng = np.random.default_rng(7)
    out = {f"n{n}": list(rng.normal(0.1, 0.4, n)) for n in (1, 2, 3, 4, 5, 6, 11, 12, 30, 48, 50, 51, 120)}
    out |= {f"t{n}": [round(float(v), 1) for v in rng.normal(0, 0.4, n)] for n in (3, 6, 20, 48, 70)}
    return out | {"flat": [0.5] * 9, "edge": [0.2] * 9, "low": [-0.9] * 4, "zeros": [0.2, 0.2, 0.7, -0.1, 0.2], "gaps": [None, float("nan"), 0.3, 0.1, 0.9, 0.4]}


@pytest.fixture(scope="module")
def rows():
    return made()


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in rows.items() for v in vs], "key string, x double")


def test_against_plain_loops(spark, rows):
    got = {r["key"]: r for r in series.tests(table(spark, rows), ["key"], "x", 0.2).collect()}
    assert set(got) == set(rows)
    for key, values in rows.items():
        v = np.array([x for x in values if x is not None and not math.isnan(x)], float)
        r, n = got[key], len(v)
        assert r.n == n and math.isclose(r["mean"], v.mean(), rel_tol=1e-12)
        for side, d in (("greater", v - 0.2), ("less", -(v + 0.2))):
            plus, p = rank_tail([float(x) for x in d])
            assert math.isclose(r["w_" + side], plus) and (p is None and r["rank_" + side] is None or math.isclose(r["rank_" + side], p, rel_tol=1e-9, abs_tol=1e-12))
            if n < 2 or np.ptp(v) < 1e-12 and abs(d.mean()) < 1e-12:
                assert r["t_" + side] is None
            else:
                t = d.mean() / (v.std(ddof=1) / math.sqrt(n)) if np.ptp(v) >= 1e-12 else math.copysign(math.inf, d.mean())
                assert math.isclose(r["t_" + side], t_tail(t, n - 1), rel_tol=1e-7, abs_tol=1e-9)


def test_normality_published_example(spark):
    """Eleven weights of the original paper on the test: W = 0.79, p < 0.01. Normal scores look normal, a skewed sample does not."""
    scores = [float(series.NormalDist().inv_cdf((i + 0.5) / 40)) for i in range(40)]
    rows = {"weights": [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], "scores": scores, "skewed": [math.exp(2 * v) for v in scores], "three": [1.0, 2.0, 3.0], "short": [1.0, 2.0]}
    p = {r["key"]: r.normal_p for r in series.tests(table(spark, rows), ["key"], "x", 0.0).collect()}
    assert 0.005 < p["weights"] < 0.01 and p["scores"] > 0.99 and p["skewed"] < 1e-6 and math.isclose(p["three"], 1.0, abs_tol=1e-6) and p["short"] is None


def test_false_alarms(spark):
    """Of normal samples about five in a hundred look unusual at that level, at every length."""
    rng = np.random.default_rng(3)
    rows = {f"{n}-{i}": list(rng.normal(5, 2, n)) for n in (8, 20, 48) for i in range(300)}
    got = series.tests(table(spark, rows), ["key"], "x", 0.0).select(F.split_part("key", F.lit("-"), F.lit(1)).alias("n"), (F.col("normal_p") < 0.05).cast("int").alias("odd"))
    assert all(0.02 < r.share < 0.09 for r in got.groupBy("n").agg(F.avg("odd").alias("share")).collect())


def test_classes(spark):
    rng = np.random.default_rng(0)
    rows = {"D": list(0.5 + 0.05 * rng.standard_normal(30)), "F": list(-0.5 + 0.05 * rng.standard_normal(30)), "N": list(0.05 * rng.standard_normal(30)),
            "D by ranks": [0.9] * 20 + [0.1] * 3, "NN": [0.5, 0.6, 0.7], "N on the edge": [0.2] * 5, "NN of two": [0.9, 0.9], "D flat": [0.9] * 4}
    got = {r["key"]: r.grp for r in series.classes(table(spark, rows), ["key"], "x", 0.2, 4).collect()}
    assert got == {k: k.split()[0] for k in rows}
    assert {r["key"]: r.grp for r in series.classes(table(spark, rows), ["key"], "x", 0.2, 2).collect()}["NN of two"] == "NN"


def test_place_classes(spark):
    rows = [("a", 0.9, 1.0, None), ("a", 0.8, 3.0, 5.0), ("a", 0.7, 8.0, 7.0), ("a", None, 100.0, 100.0), ("b", 0.1, 1.0, None)]
    df = spark.createDataFrame(rows, "loc string, ice double, jobs double, inc double")
    got = {r["loc"]: (r.grp, r.ice, r.jobs, r.inc) for r in series.place_classes(df, "loc", "ice", ["jobs", "inc"]).collect()}
    assert got == {"a": ("D", 0.8, 3.0, 6.0), "b": ("NN", 0.1, 1.0, None)}


def test_exact_tails():
    assert series.signed_rank_tails(5)[15] == 1 / 32 and series.signed_rank_tails(5)[14] == 2 / 32 and abs(series.signed_rank_tails(48)[0] - 1) < 1e-12


def test_rank_correlation_gate(spark):
    from copresence.operators import compare
    rows = [("up", i, i * i) for i in range(1, 9)] + [("none", i, (i * 5) % 7) for i in range(1, 8)] + [("flat", i, 1) for i in range(5)] + [("two", 1, 2), ("two", 2, 1)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    got = {r.g: r for r in compare.spearman(df, ["g"], "x", "y").collect()}
    assert got["up"].rho == pytest.approx(1) and got["up"].p == 0.0 and got["flat"].rho is None and got["two"].p is None
    t = got["none"].rho * math.sqrt(5 / (1 - got["none"].rho ** 2))
    assert got["none"].p == pytest.approx(2 * t_tail(abs(t), 5), rel=1e-6)
    assert {r.g for r in compare.spearman(df, ["g"], "x", "y", gate=0.05).collect()} == {"up"}


def test_chain_features_read_trips_once(spark):
    from copresence.operators import survey
    rows = [(1, 1, 5, 2, 7, 8), (1, 2, 9, 3, 8, 7), (1, 2, 11, 2, 7, 7), (2, 1, 4, 0, 3, 4), (3, 1, 4, 2, 3, 4), (3, 4, 2, 2, 4, 3)]
    trips = spark.createDataFrame(rows, "sub_id long, trip_id int, dep int, purpose int, origin int, desti int")
    out = survey.chain_features(trips, ["dep", "trip_id", "desti", "origin"])
    assert {tuple(r) for r in out.collect()} == {(1, 1, 1, 1, 1), (2, 0, 0, 0, 1), (3, 1, 1, 0, 1)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
