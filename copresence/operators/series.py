"""Class of a series of values against a band, by tests over sorted arrays.

A series is one array. Series of one length are the rows of a matrix and are tested together, a batch at a time, so that no step is taken for each
series by itself. What depends on the length only (order-statistic coefficients of the normality test, tail of the exact signed-rank distribution) is
worked out once for each length.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from copresence.functions.tails import normal_tail_of, t_tail_of
from copresence.session import cut

#: Longest series with an exact signed-rank tail, and longest one that the normality test's approximation holds for.
EXACT = 50
LONGEST = 5000


def normal_weights(n: int) -> np.ndarray:
    """Weights of the ordered values in the normality test (n of 3 to 5000), by the published polynomials."""
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = float(m @ m), 1 / math.sqrt(n)
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    # fixed values: polynomials for the last and the last but one weight, highest power first
    last = m[-1] / math.sqrt(ss) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
    if n <= 5:
        a = m / math.sqrt((ss - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    else:
        prior = m[-2] / math.sqrt(ss) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
        a = m / math.sqrt((ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prior**2))
        a[-2], a[1] = prior, -prior
    a[-1], a[0] = last, -last
    return a


def signed_rank_tails(n: int) -> np.ndarray:
    """P(T+ >= k) for k from 0: every rank is positive with chance one half, so the distribution is a convolution rank by rank."""
    share = np.zeros(n * (n + 1) // 2 + 1)
    share[0] = 1.0
    for r in range(1, n + 1):
        moved = np.concatenate([np.zeros(r), share[:-r]])
        share = (share + moved) / 2
    return np.cumsum(share[::-1])[::-1]


#: Numbers of series that are tested at once.
AT_ONCE = 500_000
#: Columns of a tested series.
TESTED = ("mean", "normal_p", "t_greater", "t_less", "w_greater", "w_less", "rank_greater", "rank_less")

# what depends on the length only is worked out once for each length that a worker meets
_weights, _tails = lru_cache(LONGEST)(normal_weights), lru_cache(EXACT)(signed_rank_tails)


def _sum(a: np.ndarray) -> np.ndarray:
    """Sums along rows, from the first value to the last."""
    return np.add.accumulate(a, axis=1)[:, -1]


def _poly(x: np.ndarray, powers: list[float]) -> np.ndarray:
    out = np.full(len(x), powers[0])
    for c in powers[1:]:
        out = out * x + c
    return out


def normal_p(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """p of the normality statistic W for n values (3 or more), by the published approximation; not-a-number where W is."""
    n = n.astype(float)
    y, ln = np.log(np.maximum(1 - w, 1e-300)), np.log(n)
    three = np.maximum(6 / math.pi * (np.arcsin(np.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    # fixed values: polynomials of mean and deviation of the transformed statistic, highest power first
    gamma = 0.459 * n - 2.273
    few = (-np.log(gamma - y) - _poly(n, [-0.0006714, 0.025054, -0.39978, 0.5440])) / np.exp(_poly(n, [-0.0020322, 0.062767, -0.77857, 1.3822]))
    many = (y - _poly(ln, [0.0038915, -0.083751, -0.31082, -1.5861])) / np.exp(_poly(ln, [0.0030302, -0.082676, -0.4803]))
    tail = normal_tail_of(np.where(n <= 11, few, many))
    return np.where(n == 3, three, np.where((n <= 11) & (y >= gamma), 0.0, tail))


def _signed_ranks(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """T+, the number of values, and the sum of t**3 - t over ties, of each row of differences; zeros are left out and a run of equal sizes
    takes the middle of its ranks."""
    a = np.abs(d)
    order = np.argsort(a, axis=1, kind="stable")
    a, up = np.take_along_axis(a, order, 1), np.take_along_axis(d, order, 1) > 0
    zeros = (a == 0).sum(axis=1)
    new = np.ones(a.shape, bool)
    new[:, 1:] = a[:, 1:] != a[:, :-1]
    first = np.flatnonzero(new)
    row, at = np.divmod(first, a.shape[1])
    run = np.diff(np.append(first, a.size))
    rank = np.repeat(at - zeros[row] + (run + 1) / 2, run).reshape(a.shape)
    ties = np.bincount(row, np.where(a.ravel()[first] != 0, run * (run.astype(float) ** 2 - 1), 0.0), len(a))
    return np.where(up, rank, 0.0).sum(axis=1), a.shape[1] - zeros, ties


def _rank_tail(plus: np.ndarray, n: np.ndarray, ties: np.ndarray, whole: int) -> np.ndarray:
    """P(T+ at least as large): exact where no value is zero or tied and few are there, else the tie-corrected normal score."""
    size = n.astype(float)
    out = normal_tail_of((plus - size * (size + 1) / 4) / np.sqrt(size * (size + 1) * (2 * size + 1) / 24 - ties / 48))
    if whole <= EXACT:
        exact = (n == whole) & (ties == 0)
        out[exact] = _tails(whole)[plus[exact].astype(int)]
    return np.where(n == 0, 1.0, out)


def _tested(v: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The columns of rows of one length, without the tails that are taken for all lengths at once."""
    n = v.shape[1]
    v = np.sort(v, axis=1)
    mean = _sum(v) / n
    ss = _sum((v - mean[:, None]) ** 2)
    flat = v[:, -1] - v[:, 0] < 1e-12
    w = np.full(len(v), np.nan)
    if 3 <= n <= LONGEST:
        w = np.where(flat, np.nan, np.fmin(1.0, _sum(_weights(n) * v) ** 2 / ss))
    out = {"mean": mean, "normal_p": np.where(flat & (n >= 3), 1.0, np.nan), "w": w}
    for side, d in (("greater", v - threshold), ("less", -(v + threshold))):
        gap = mean - threshold if side == "greater" else -(mean + threshold)
        far = np.where(np.abs(gap) >= 1e-12, np.sign(gap) * np.inf, np.nan)
        out[f"t_{side}"] = np.where(flat, far, gap / (np.sqrt(ss / (n - 1)) / math.sqrt(n))) if n > 1 else np.full(len(v), np.nan)
        plus, held, ties = _signed_ranks(d)
        out[f"w_{side}"], out[f"rank_{side}"] = plus, _rank_tail(plus, held, ties, n)
    return out


def _test(threshold: float):
    """The tests of lists of numbers, batch by batch; nulls and not-a-numbers of a list are left out."""
    kind = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in TESTED]])

    @F.arrow_udf(kind)
    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null is not a number then
        sizes, known = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), ~np.isnan(flat)
        n = np.bincount(np.repeat(np.arange(len(lists)), sizes)[known], minlength=len(lists))
        flat, starts = flat[known], np.cumsum(n) - n
        out = {c: np.full(len(lists), np.nan) for c in (*TESTED, "w")}
        with np.errstate(all="ignore"):
            for size in np.unique(n[n > 0]):
                rows, step = np.flatnonzero(n == size), max(1, AT_ONCE // size)
                for some in (rows[i:i + step] for i in range(0, len(rows), step)):
                    for c, got in _tested(flat[starts[some][:, None] + np.arange(size)], threshold).items():
                        out[c][some] = got
            tested = ~np.isnan(out["w"])
            out["normal_p"][tested] = normal_p(out["w"][tested], n[tested])
            for c in ("t_greater", "t_less"):
                out[c] = t_tail_of(out[c], n - 1)
        for c in ("w_greater", "w_less"):
            out[c][n == 0] = 0.0
        for c in ("rank_greater", "rank_less"):
            out[c][n == 0] = 1.0
        null = {c: n == 0 if c == "mean" else np.isnan(out[c]) for c in TESTED}
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), *[pa.array(out[c], mask=null[c]) for c in TESTED]], names=["n", *TESTED])

    return run


def _series(df: DataFrame, by: list[str], x: str, threshold: float) -> DataFrame:
    if isinstance(df.schema[x].dataType, T.ArrayType):
        series = df.select(*by, F.col(x).cast("array<double>").alias("v"))
    else:
        value = F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
        series = df.groupBy(*by).agg(F.collect_list(value).alias("v"))
    return series.select(*by, _test(threshold)("v").alias("r")).select(*by, "r.*")


def tests(df: DataFrame, by: list[str], x: str, threshold: float) -> DataFrame:
    """Per series: by, n, mean, normal_p, t_greater (mean above the threshold), t_less (below its negative), and the same by signed
    ranks (rank_greater, rank_less, w_greater, w_less). Null and not-a-number are left out; a constant series counts as normal, and
    on the threshold itself it has no t test (null). The statistics of too short a series are null. Where x is an array, a row is a series."""
    # stored, as a filter on a statistic would otherwise run the tests once more
    return cut(_series(df, by, x, threshold))


def classes(df: DataFrame, by: list[str], x: str, threshold: float = 0.2, least: int = 4, name: str = "grp", level: float = 0.05) -> DataFrame:
    """D above the threshold, F below its negative, N between, NN for fewer than `least` values (3 at least are needed)."""
    got = _series(df, by, x, threshold)
    normal = F.col("normal_p") > level
    above = F.when(normal, F.col("t_greater")).otherwise(F.col("rank_greater")) < level
    below = F.when(normal, F.col("t_less")).otherwise(F.col("rank_less")) < level
    # stored, as a filter on the class would otherwise run the tests once more
    return cut(got.select(*by, F.when(F.col("n") < max(least, 3), "NN").when(above, "D").when(below, "F").otherwise("N").alias(name)))


def place_classes(metrics: DataFrame, place: str, x: str, attributes: list[str], threshold: float = 0.2, least: int = 3, name: str = "grp") -> DataFrame:
    """Class of each place's series, with the median of the index and of every visitor attribute over the same half hours.

    Half hours without the index take no part; an attribute's nulls are left out of its median. A place has at most 48 half hours a day type.
    """
    with_index = metrics.where(F.col(x).isNotNull() & ~F.isnan(F.col(x)))
    middle = [F.median(F.when(~F.isnan(F.col(a).cast("double")), F.col(a))).alias(a) for a in dict.fromkeys([x, *attributes])]
    return classes(with_index, [place], x, threshold, least, name).join(with_index.groupBy(place).agg(*middle), place)
