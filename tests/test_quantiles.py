import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from copresence.operators import ordered, quantiles


def interp(xs, ws, p):
    order = sorted(zip(xs, ws))
    x, w = np.array([a for a, _ in order], float), np.array([b for _, b in order], float)
    return float(np.interp(p, (np.cumsum(w) - w / 2) / w.sum(), x))


def ecdf(xs, ws, p):
    vals = sorted(set(xs))
    tot, cum = sum(ws), 0
    for i, v in enumerate(vals):
        cum += sum(b for a, b in zip(xs, ws) if a == v)
        if cum == p * tot and i + 1 < len(vals):
            return (v + vals[i + 1]) / 2
        if cum >= p * tot:
            return v


@pytest.mark.parametrize("cuts", [[], [0.0], [-1.0, 0.0, 1.0, 2.0], None])
def test_against_brute_force(spark, cuts):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), round(rng.gauss(0, 2), 1), float(rng.randint(1, 4))) for _ in range(400)] + [("d", 1.5, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for fn, ref in ((quantiles.wquantile_interp, interp), (quantiles.wquantile_ecdf, ecdf)):
        got = {(r.g, r.prob): r.value for r in fn(df, ["g"], "x", "w", probs, cuts).collect()}
        assert len(got) == 4 * len(probs)
        for (g, p), v in got.items():
            xs, ws = zip(*[(a, b) for k, a, b in rows if k == g])
            if fn is quantiles.wquantile_ecdf and p == 0.0:
                assert v == min(xs)
            else:
                assert math.isclose(v, ref(xs, ws, p), abs_tol=1e-9), (fn, g, p)
    plain = {(r.g, r.prob): r.value for r in quantiles.quantiles(df, ["g"], "x", probs, cuts).collect()}
    for (g, p), v in plain.items():
        assert math.isclose(v, float(np.quantile([a for k, a, _ in rows if k == g], p)), abs_tol=1e-9)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from([0.1, 0.3, 1 / 3, 0.7])), min_size=1, max_size=12), st.lists(st.integers(0, 6), max_size=3, unique=True))
def test_one_value_per_group_whatever_the_cuts(spark, rows, cuts):
    df = spark.createDataFrame([(float(a), b) for a, b in rows], "x double, w double")
    got = quantiles.wquantile_interp(df, [], "x", "w", [0.5], sorted(float(c) for c in cuts)).collect()
    assert len(got) == 1
    assert math.isclose(got[0].value, interp([a for a, _ in rows], [b for _, b in rows], 0.5), abs_tol=1e-6)


def test_equal_weights_give_plain_median(spark):
    xs = [float(v) for v in (5, 1, 4, 2, 3, 9, 7)]
    df = spark.createDataFrame([(v, 2.0) for v in xs], "x double, w double")
    assert quantiles.wquantile_interp(df, [], "x", "w", [0.5]).first().value == 4.0
    assert quantiles.wquantile_ecdf(df, [], "x", "w", [0.5], [2.0, 4.0]).first().value == 4.0


def test_sums_stand_for_rows(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 4.0, 1.0), ("a", 4.0, 1.0), ("a", 7.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    packed = df.groupBy("g", "x").agg(F.sum("w").alias("w"), F.min("w").alias("w_min"), F.max("w").alias("w_max"))
    want = interp([r[1] for r in rows], [r[2] for r in rows], 0.5)
    assert math.isclose(quantiles.wmedian_of_sums(packed, ["g"], "x", [4.0]).first().value, want)


def test_sequences_cross_slots(spark):
    rows = [("u", t, t // 10) for t in (1, 3, 12, 13, 45, 46, 99)] + [("v", 5, 0)]
    df = spark.createDataFrame(rows, "k string, t int, slot int")
    prev = {(r.k, r.t): r.prev_t for r in ordered.previous(df, ["k"], "slot", ["t"], ["t"]).collect()}
    nxt = {(r.k, r.t): r.next_t for r in ordered.following(df, ["k"], "slot", ["t"], ["t"]).collect()}
    assert prev[("u", 1)] is None and prev[("u", 12)] == 3 and prev[("u", 45)] == 13 and prev[("v", 5)] is None
    assert nxt[("u", 99)] is None and nxt[("u", 13)] == 45
    num = {(r.k, r.t): r.seq for r in ordered.number(df, ["k"], "slot", ["t"]).collect()}
    assert [num[("u", t)] for t in (1, 3, 12, 13, 45, 46, 99)] == list(range(1, 8))
    run = {(r.k, r.t): r.s for r in ordered.running_sum(df, ["k"], "slot", ["t"], F.col("t"), "s").collect()}
    assert run[("u", 46)] == 1 + 3 + 12 + 13 + 45 + 46


def test_values_are_summed_in_wanted_pieces_only(spark, monkeypatch):
    """Rows read twice give the same quantiles, and only the pieces that hold one are summed value by value."""
    rows = [(g, float((i * 37) % 400) / 4, 1 + i % 3) for g in ("a", "b") for i in range(400 if g == "a" else 90)] + [("a", None, 1), ("b", float("nan"), 2), ("c", 7.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, w int")
    cuts = [float(c) for c in range(5, 100, 5)]
    want = {(r.g, r.prob): r.value for r in quantiles.wquantile_ecdf(df, ["g"], "x", "w", [0.25, 0.5, 0.75], cuts).collect()}
    seen = []
    monkeypatch.setattr(quantiles, "stored", lambda t: seen.append(t) or t.localCheckpoint())
    got = {(r.g, r.prob): r.value for r in quantiles.wquantile_ecdf(df, ["g"], "x", "w", [0.25, 0.5, 0.75], cuts, again=True).collect()}
    assert got == want and len(want) == 9
    assert seen[0].select("g", "_piece").distinct().count() == 7
