"""Hard negatives against plain loops over whole numbers."""

import math
import random

import numpy as np
import pytest

from copresence.llm import hard_negatives as hn
from odd_rows import got

SCHEMA = "vec_id long, embedding array<double>, label int, row string, v string, score string, positives string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (16, 16, 16), (33, 20, 47), (64, 64, 64), (70, 1, 90), (0, 4, 3)])
@pytest.mark.parametrize("leaf", [1, 4])
def test_strassen(shape, leaf):
    m, k, n = shape
    rng = np.random.default_rng(m + n)
    a, b = rng.integers(-2**40, 2**40, (m, k)), rng.integers(-2**15, 2**15, (k, n))
    assert (hn.strassen(a, b, leaf) == a @ b).all()


def test_sums_inside_may_wrap():
    """Additions inside leave 64 bits, the product does not."""
    a = np.zeros((4, 4), np.int64)
    a[0, 0] = a[3, 3] = 2**62
    b = np.eye(4, dtype=np.int64)
    assert (hn.strassen(a, b, 1) == a).all()


def test_scores_beyond_64_bits():
    a, b = np.array([[2**40, 1], [-2**40, 0], [3, 2]]), np.array([[2**40, 0], [1, 1]])
    assert hn.scores(a, b).tolist() == [[2**63 - 1, 2**40 + 1], [-2**63 + 1, -2**40], [3 * 2**40, 5]]


def test_best_lists_merge():
    rng = np.random.default_rng(5)
    whole = rng.integers(0, 6, (20, 50))
    whole[rng.random(whole.shape) < 0.3] = hn._EMPTY
    best = hn.Best(20, 4)
    for at in range(0, 50, 7):
        best.offer(whole[:, at:at + 7].copy(), at)
    want = [(i, p, s) for i in range(20) for s, p in sorted(((s, p) for p, s in enumerate(whole[i].tolist()) if s != hn._EMPTY), key=lambda x: (-x[0], x[1]))[:4]]
    assert sorted(zip(*(x.tolist() for x in best.found()))) == sorted(want)


def brute(rows, every, k=5, m=3, window=(50, 95)):
    sound = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, (a, label, v) in enumerate(sound):
        if a % every:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), b, j) for j, (b, _, w) in enumerate(sound)]
        alike = sorted(s for s in score if s[2] != i and sound[s[2]][1] == label)[:k]
        other = sorted(s for s in score if sound[s[2]][1] != label)
        for p, b, _ in alike:
            fit = [s for s in other if window[0] * -p <= 100 * -s[0] <= window[1] * -p][:m]
            out += [(a, b, n + 1, c, -p, -s) for n, (s, c, _) in enumerate(fit)]
    return sorted(out)


MOVED = "CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END"


def mined(spark, rows, every=5, **sizes):
    df = spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA)
    return sorted(got(hn.mine(df, f"vec_id % {every} = 0", MOVED, **sizes)))


def made(n, seed, values):
    rnd = random.Random(seed)
    return [(i, [rnd.choice(values) for _ in range(6)], rnd.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"cell_anchors": 4, "cell_rows": 9, "tile": 4}])
@pytest.mark.parametrize("values", [[0.0, 0.5, 1.0], [-1.0, -0.3, 0.002, 0.7, 1.2]])
def test_equals_brute(spark, sizes, values):
    """Many ties, negative scores, repeated rows, more cells than one."""
    rows = made(90, 3, values)
    rows += rows[:20] + rows[:6]
    want = brute(rows, 5)
    assert len(want) > 40 and mined(spark, rows, **sizes) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (5, None, 1), (10, [], 1), (15, [1.0, None], 1), (20, [1.0, inf], 2), (25, [1.0, nan], 2), (30, [1.0, 0.0], None),
            (-35, [0.0, 0.0], 1), (2, [1.0], 2), (3, [0.5, 0.5, 0.5], 1), (4, [0.5, 0.4], 2), (4, [0.5, 0.4], 2), (50, [1e18, 1e18], 1), (51, [1e17, 5e17], 2), (7, [0.9, 0.9], 1)]
    out = mined(spark, rows)
    small = [r for r in rows if r[0] not in (50, 51)]
    assert mined(spark, small) == brute(small, 5) != []
    assert {r[0] for r in out} <= {0, 10, -35, 50}  # scores beyond 64 bits do no harm
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == []
