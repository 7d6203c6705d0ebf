"""Replicate vectors against replicates that are written out one by one."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from copresence.functions import draws
from copresence.operators import bootstrap, compare

N = 40


def cells(rows):
    """(group, x, w) to the number of rows and a key."""
    out = defaultdict(int)
    for r in rows:
        out[r] += 1
    return out


def picker():
    def counts(keys, means, n):
        u = ((7919 * keys)[:, None] + (104729 * np.arange(1, n + 1))[None, :]) % 10007
        return draws.poisson_quantile(means, (u + 0.5) / 10007)

    return counts


counts = picker()  # a local function, so that workers need not import this file


def plain_median(rows, sim, key):
    """rows: (x, w, copies)."""
    total = defaultdict(float)
    for x, w, c in rows:
        if c:
            total[x] += w * c
    half, upto, xs = sum(total.values()) / 2, 0.0, sorted(total)
    for i, x in enumerate(xs):
        upto += total[x]
        if upto >= half:
            return (x + xs[i + 1]) / 2 if upto == half and i + 1 < len(xs) else x
    return None


def made(seed, n, values, weights):
    rng = np.random.default_rng(seed)
    return [(str(rng.choice(["a", "a", "a", "b"])), float(rng.choice(values)), float(rng.choice(weights))) for _ in range(n)]


CASES = {
    "ties": made(1, 300, range(6), [1, 2]), "even": made(2, 12, range(12), [1]), "wide": made(3, 500, range(400), range(1, 40)),
    "heavy": made(4, 400, [5] * 9 + [1, 9], range(1, 300)), "one": [("a", 3.0, 1.0)],
}


@pytest.mark.parametrize("piece, block", [(20_000, 500), (15, 4)])
@pytest.mark.parametrize("case", CASES)
def test_medians(spark, monkeypatch, case, piece, block):
    monkeypatch.setattr(bootstrap, "PIECE", piece)
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    rows = CASES[case]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    key = F.ascii("g") * 1_000_000 + (F.col("_x") * 1000 + F.col("_w")).cast("long")
    got = {(r.g, r.sim): r.value for r in bootstrap.medians(df, ["g"], "x", "w", N, counts, key).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = [(x, w, counts(np.array([ord(g) * 1_000_000 + int(x * 1000 + w)]), np.array([float(k)]), N)[0]) for (h, x, w), k in cells(rows).items() if h == g]
        for sim in range(N):
            m = plain_median([(x, w, c[sim]) for x, w, c in own], sim, None)
            if m is not None:
                want[g, sim + 1] = m
    assert got == want


@pytest.mark.parametrize("piece, block", [(20_000, 500), (10, 3)])
@pytest.mark.parametrize("by", [["g"], []])
def test_signed_ranks(spark, monkeypatch, piece, block, by):
    monkeypatch.setattr(bootstrap, "PIECE", piece)
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    rows = made(5, 200, range(-20, 21), [1, 2, 3])
    df = spark.createDataFrame(rows, "g string, x double, w double")
    key = (F.ascii("g") if by else F.lit(0)) * 1000 + (F.col("_v") + 100).cast("long")
    got = {(r.g if by else None, r.sim): (round(r.t_plus, 6), r.n, round(r.ties, 6)) for r in bootstrap.signed_ranks(df, by, "x", "w", 3.0, N, counts, key).collect()}
    want = {}
    for g in {r[0] for r in rows} if by else {None}:
        own = [r for r in rows if not by or r[0] == g]
        whole, mean = sum(w for *_, w in own), defaultdict(float)
        for _, x, w in own:
            mean[x - 3] += w * len(own) / whole
        drawn = {v: counts(np.array([(ord(g) if by else 0) * 1000 + int(v) + 100]), np.array([m]), N)[0] for v, m in mean.items() if v}
        for sim in range(N):
            values = sorted((v for v, c in drawn.items() for _ in range(c[sim])), key=abs)
            size = np.abs(values)
            rank = [(np.searchsorted(size, abs(v), "left") + np.searchsorted(size, abs(v), "right") + 1) / 2 for v in values]
            _, t = np.unique(size, return_counts=True)
            want[g, sim + 1] = (sum(r for v, r in zip(values, rank) if v > 0), len(values), float((t.astype(float) ** 3 - t).sum()))
    assert got == want


def test_correlation_error(spark):
    rows = [(x, x + y, w) for (_, x, w), (_, y, _) in zip(made(6, 150, range(9), [1, 2]), made(7, 150, range(9), [1]))]
    df = spark.createDataFrame(rows, "x double, y double, w double")
    key = (F.col("_x") * 10_000 + F.col("_y") * 10 + F.col("_w")).cast("long")
    got = compare.wcorr_se(df, [], "x", "y", "w", N, counts=counts, key=key).first()
    own = [(x, y, w, counts(np.array([int(x * 10_000 + y * 10 + w)]), np.array([float(k)]), N)[0]) for (x, y, w), k in cells(rows).items()]

    def r(weights):
        x, y, w = np.array([o[0] for o in own]), np.array([o[1] for o in own]), np.array(weights)
        dx, dy = x - np.average(x, weights=w), y - np.average(y, weights=w)
        return (w * dx * dy).sum() / math.sqrt((w * dx * dx).sum() * (w * dy * dy).sum())

    assert math.isclose(got.se, np.std([r([o[2] * o[3][s] for o in own]) for s in range(N)], ddof=1), rel_tol=1e-9)
    assert math.isclose(got.r, r([o[2] * cells(rows)[o[:3]] for o in own]), rel_tol=1e-9)


def test_partitioning_and_nulls_do_not_matter(spark):
    rows = made(8, 400, range(50), [1, 2]) + [("a", None, 1.0), ("a", 1.0, None), ("a", 1.0, 0.0), ("a", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    a, b = (sorted(map(tuple, bootstrap.medians(d, ["g"], "x", "w", 200).collect())) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 400
    assert bootstrap.medians(df.limit(0), ["g"], "x", "w", 20).count() == 0


def test_error_of_a_median(spark):
    """1000 replicates of 2000 normal values: the error of their median is about 1.2533/sqrt(n)."""
    df = spark.createDataFrame([(float(v), 1.0) for v in np.random.default_rng(9).normal(size=2000)], "x double, w double")
    got = compare.boot_median(df, [], "x", "w").first()
    assert abs(got.median) < 0.1 and abs(got.se / (1.2533 / math.sqrt(2000)) - 1) < 0.25


def test_poisson_quantile():
    u = (np.arange(200_000) + 0.5) / 200_000
    for mean in (0.2, 1.0, 7.5, 40.0, 900.0, 1e5):
        k = draws.poisson_quantile(np.array([mean]), u[None, :])[0]
        assert abs(k.mean() / mean - 1) < 0.01 and abs(k.var() / mean - 1) < 0.02 and (np.diff(k) >= 0).all()
    assert (draws.poisson_quantile(np.array([0.0, 1.0]), np.full((2, 3), 0.36))[0] == 0).all()
    once = draws.hashed_uniform(np.array([5, -7, 5]), 1000, 3)
    assert (once[0] == once[2]).all() and abs(once.mean() - 0.5) < 0.02 and 0 < once.min() and once.max() < 1


def test_multinomial_tree():
    """Counts add up, follow the shares in mean and spread, and do not depend on the rows around them."""
    shares = np.array([0.5, 0.2, 0.1, 0.1, 0.06, 0.03, 0.01])
    keys = np.arange(4000) * 7919

    def uniforms(own, node):
        return draws.hashed_uniform(own, 1, node)[:, 0]

    row, where, count = draws.multinomial_tree(1000, shares, uniforms, keys)
    table = np.zeros((len(keys), len(shares)))
    table[row, where] = count
    assert (table.sum(axis=1) == 1000).all() and (count > 0).all()
    assert np.abs(table.mean(axis=0) / (1000 * shares) - 1).max() < 0.02
    assert np.abs(table.var(axis=0) / (1000 * shares * (1 - shares)) - 1).max() < 0.12
    some = draws.multinomial_tree(1000, shares, uniforms, keys[5:6])
    assert dict(zip(some[1].tolist(), some[2].tolist())) == {i: int(c) for i, c in enumerate(table[5]) if c}


def test_binomial_quantile():
    u = (np.arange(100_000) + 0.5) / 100_000
    for n, p in ((1, 0.3), (10, 0.05), (1000, 0.5), (1000, 0.97), (50_000, 0.001)):
        k = draws.binomial_quantile(np.full(len(u), n), p, u)
        assert abs(k.mean() - n * p) < 0.01 * max(n * p, 1) and abs(k.var() / (n * p * (1 - p)) - 1) < 0.02 and 0 <= k.min() and k.max() <= n
    assert draws.binomial_quantile(np.array([0, 3]), 0.5, np.array([0.9, 0.99])).tolist() == [0, 3]


def test_drawn_distances(spark):
    from copresence.operators import nullmodel
    decay = spark.createDataFrame([(i, f) for i, f in enumerate([0.0, 0.4, 0.3, 0.2, 0.1])], "d int, fd double")
    people = spark.createDataFrame([(i, "Shop") for i in range(300)], "uid long, tag string")
    a, b = (sorted(map(tuple, nullmodel.drawn_distances(p, decay, F.xxhash64("uid", "tag")).collect())) for p in (people, people.repartition(5)))
    assert a == b and {r[2] for r in a} == {1, 2, 3, 4}
    total = {d: sum(r[3] for r in a if r[2] == d) / 300_000 for d in range(1, 5)}
    assert all(abs(total[d] - f) < 0.01 for d, f in zip(total, [0.4, 0.3, 0.2, 0.1]))
    assert nullmodel.drawn_distances(people, decay.limit(0), F.col("uid")).count() == 0


@pytest.mark.parametrize("means", [[1.0] * 9, [0.3, 2.5, 2.5, 0.3, 40.0, 2.5, 40.0, 0.3], [1.0, 2.0, 3.0], [500.0] * 4, [0.0, 1.0, 1.0, 1.0], []])
def test_counts_by_leading_bits(means):
    keys, means = np.arange(len(means)) * 7919 - 5, np.array(means)
    plain = draws.poisson_quantile(means, draws.hashed_uniform(keys, 5000, 3))
    assert (draws.hashed_poisson(keys, means, 5000, 3) == plain).all()


def test_counts_are_not_compared_one_by_one(monkeypatch):
    """Of a million numbers only those in buckets with a step of the shares are looked up."""
    looked, search = [], np.searchsorted
    draws.hashed_poisson(np.arange(4), np.ones(4), 10, 1)  # the buckets are known
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: looked.append(np.size(v)) or search(a, v, *more))
    bootstrap.seeded(1)(np.arange(1000), np.ones(1000), 1000)
    assert 0 < sum(looked) < 20_000


def test_numbers_are_mixed_whole_only_where_looked_up(monkeypatch):
    """The counts of most numbers follow from bits that the last step of mixing leaves as they are."""
    mixed, mix = [], draws._mix
    monkeypatch.setattr(draws, "_mix", lambda x, *more: mixed.append(x.size) or mix(x, *more))
    keys, means = np.arange(1000), np.ones(1000)
    found = draws.hashed_poisson(keys, means, 1000, 1)
    assert sum(mixed) == 1000  # the keys
    assert (found == draws.poisson_quantile(means, draws.hashed_uniform(keys, 1000, 1))).all()


def test_groups_stay_where_they_are(spark):
    """Rows meet the sum of their group without a shuffle by group."""
    from copresence.session import beside
    rows = spark.range(1000).selectExpr("id % 3 g", "id x")
    plan = beside(rows, rows.groupBy("g").agg(F.sum("x").alias("t")), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_many_cuts(spark):
    from copresence.operators import ordered
    cuts = [float(i) for i in range(0, 400, 2)]
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 2.0, 399.0, float("nan"), None)], "x double")
    few = rows.select(ordered.piece_of(F.col("x"), cuts[:100]).alias("p"))
    many = rows.select(ordered.piece_of(F.col("x"), cuts).alias("p"))
    assert [r.p for r in many.collect()] == [0, 0, 1, 1, 200, 200, 200] and [r.p for r in few.collect()] == [0, 0, 1, 1, 100, 100, 100]
    assert "aggregate(" not in many._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["effect_size", "group_regression", "weighted_moments", "weighted_correlation"])
def test_no_shuffle_of_rows_by_group(spark, tables, name):
    """Only the groups' sums are shuffled: every exchange stands on a partial sum."""
    from catalog import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # lineitem is larger
    try:
        plan = QUERIES[name](tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    under = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert under and all("partial" in u for u in under)


def test_rank_correlation_moves_no_rows(spark, tables):
    """Rows are summed to values before any shuffle; they are not joined with the ranks of the many values."""
    from catalog import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # lineitem is larger
    try:
        plan = QUERIES["significant_rank_correlations"](tables)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    starts = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert starts and all("Aggregate" in next(p for p in plan[i + 1:] if "Aggregate" in p or "Scan" in p) for i in starts)
