"""Hulls and buffers against plain loops."""

import math
import random

import numpy as np
import pytest

from copresence.operators import hull

KIND = "name string, ring array<struct<x:double,y:double>>"


def turn(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def edges(points):
    """Pairs of points with all others on the left: the hull's edges and parts of them."""
    points = sorted(set(points))
    return [(a, b) for a in points for b in points if a != b and all(turn(a, b, c) >= 0 for c in points)]


def away(p, points):
    es = edges(points)
    if not es:
        return math.dist(p, points[0])
    if len(set(points)) > 2 and all(turn(a, b, p) >= 0 for a, b in es) and any(turn(a, b, c) for a, b in es for c in points):
        return 0.0
    out = []
    for a, b in es:
        f = ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / math.dist(a, b) ** 2
        f = min(max(f, 0), 1)
        out.append(math.dist(p, (a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1]))))
    return min(out)


def shapes(seed):
    rng = random.Random(seed)
    out = [("a", [(float(rng.randint(0, 12)), float(rng.randint(0, 12))) for _ in range(4)]) for _ in range(6)]
    out += [("b", [(40 + rng.uniform(0, 9), rng.uniform(0, 5)) for _ in range(5)]) for _ in range(3)]
    return out + [("line", [(0.0, 30.0), (5.0, 32.0), (10.0, 34.0)]), ("dot", [(30.0, 30.0)]), ("none", [])]


@pytest.mark.parametrize("seed", [1, 2])
def test_hulls_merge(spark, seed):
    rows = shapes(seed)
    whole, parts = (
        {r["name"]: [(p["x"], p["y"]) for p in r["ring"]] for r in hull.hulls(df, ["name"]).collect()}
        for df in (spark.createDataFrame(rows, KIND).coalesce(1), spark.createDataFrame(rows, KIND).repartition(7)))
    assert whole == parts and set(whole) == {"a", "b", "line", "dot"}
    for name, ring in whole.items():
        points = [p for n, r in rows for p in r if n == name]
        if len(ring) > 2:
            assert all(turn(a, b, c) > 0 for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2]))
            assert all(turn(a, b, p) >= -1e-9 for a, b in zip(ring, ring[1:] + ring[:1]) for p in points)
        assert set(ring) <= set(points)


@pytest.mark.parametrize("buffer, cell", [(3.0, 1.0), (3.0, 40.0), (0.5, 2.0), (0.0, 1.5)])
def test_within_buffer(spark, buffer, cell):
    rng = random.Random(5)
    rows = shapes(3)
    spots = [(i, rng.uniform(-8, 55), rng.uniform(-8, 40)) for i in range(900)]
    rings = hull.hulls(spark.createDataFrame(rows, KIND), ["name"])
    got = {(r["name"], r["id"]) for r in hull.within_buffer(spark.createDataFrame(spots, "id int, x double, y double"), rings, ["name"], buffer, cell).collect()}
    want = {(n, i) for n in ("a", "b", "line", "dot") for i, x, y in spots if away((x, y), [p for m, r in rows for p in r if m == n]) <= buffer}
    assert got == want and (want or not buffer)


def test_squares_touch_the_buffer(spark):
    """A square counts where any of its points is near enough, whatever its size; squares without jobs never do."""
    zone = spark.createDataFrame([("c", [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)])], KIND).withColumnRenamed("name", "county")
    rng = np.random.default_rng(2)
    grid = [(i, float(x), float(y), float(s), int(j)) for i, (x, y, s, j) in enumerate(zip(rng.uniform(-12, 22, 600), rng.uniform(-12, 22, 600), rng.choice([1.0, 4.0], 600), rng.integers(0, 3, 600)))]
    got = {r["cell_id"] for r in hull.county_destinations(zone, spark.createDataFrame(grid, "cell_id int, x double, y double, size double, job int"), 3.0, [1.0, 4.0], cell=2.0).collect()}
    fine = np.linspace(-0.5, 0.5, 9)

    def near(x, y, s):
        return min(away((x + a * s, y + b * s), [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]) for a in fine for b in fine)

    for i, x, y, s, job in grid:
        d = near(x, y, s)
        if job and d <= 3:
            assert i in got
        elif not job or d > 3 + s / 8:  # the grid of test points is s/8 wide
            assert i not in got


def test_origins(spark):
    homes = spark.createDataFrame([(1, 7), (0, 7), (1, 8), (2, 9), (2, 99)], "county int, cell_id int")
    grid = spark.createDataFrame([(7, 0.0, 0.0), (8, 1.0, 0.0), (9, 2.0, 0.0), (10, 3.0, 0.0)], "cell_id int, x double, y double")
    assert sorted((r["county"], r["cell_id"]) for r in hull.county_origins(homes, grid).collect()) == [(0, 7), (1, 8), (2, 9)]
