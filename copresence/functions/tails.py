"""Tail probabilities as column expressions, for result rows (no Python worker is needed), and the same for arrays of numbers (`_of`), for many rows.

Continued fractions are evaluated from their far end over a sequence of terms; the tests check them against plain integration.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: the asymptotic series eight units further up, and the way back down."""
    y = x + 8
    steps = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = 1 / (y * y)
    # fixed values: the series' coefficients, Bernoulli numbers B(2k) / (2k (2k-1))
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * (691 / 360360)))))) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, good for x below (a+1)/(a+b+2), from its far end: the number of terms that
    it needs grows with the square root of the larger parameter."""
    def term(below: Column, n: Column) -> Column:
        m = F.floor(n / 2).cast("double")
        even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(n % 2 == 0, even).otherwise(odd) * x / below

    far = (40 + 8 * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(far, F.lit(1), F.lit(-1)), F.lit(1.0), term, lambda whole: 1 / whole)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a, b > 0 and x in [0, 1]."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * _fraction(a, b, x) / a
    high = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def t_tail(t: Column, df: Column) -> Column:
    """P(T > t) of Student's distribution; null for a null t or fewer than one degree of freedom."""
    t, df = t.cast("double"), df.cast("double")
    wide = beta_share(df / 2, F.lit(0.5), df / (df + t * t)) / 2
    finite = F.when(t >= 0, wide).otherwise(1 - wide)
    return F.when(t.isNull() | F.isnan(t) | (df < 1), None).when(t == float("inf"), 0.0).when(t == float("-inf"), 1.0).otherwise(finite)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution; null for null and not-a-number."""
    z = z.cast("double")
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    # near zero the series of odd powers, further out the continued fraction from its far end
    term = F.struct(x.alias("term"), x.alias("sum"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * x * x / (2 * n.cast("double") + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    near = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(60)), term, add, lambda s: s["sum"])
    far = density / F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), x, lambda below, n: x + n.cast("double") / below)
    tail = F.when(x < 2.5, near).otherwise(far)
    return F.when(z.isNull() | F.isnan(z), None).when(x > 39, F.when(z > 0, 0.0).otherwise(1.0)).when(z >= 0, tail).otherwise(1 - tail)


def _log_gamma_of(x: np.ndarray) -> np.ndarray:
    y = x + 8
    steps = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = 1 / (y * y)
    # fixed values: as in log_gamma
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * (691 / 360360)))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def _fraction_of(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    far = (40 + 8 * np.sqrt(np.maximum(a, b))).astype(int)
    whole = np.ones(len(x))
    for n in range(far.max(initial=0), 0, -1):
        m = n // 2
        term = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) if n % 2 == 0 else -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        whole = np.where(n <= far, 1 + term * x / whole, whole)
    return 1 / whole


def beta_share_of(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    inner, below = (x > 0) & (x < 1), x < (a + 1) / (a + b + 2)
    for at, swapped in ((np.flatnonzero(inner & below), False), (np.flatnonzero(inner & ~below), True)):
        p, q, y = a[at], b[at], x[at]
        front = np.exp(_log_gamma_of(p + q) - _log_gamma_of(p) - _log_gamma_of(q) + p * np.log(y) + q * np.log(1 - y))
        out[at] = 1 - front * _fraction_of(q, p, 1 - y) / q if swapped else front * _fraction_of(p, q, y) / p
    return out


def t_tail_of(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """`t_tail`; not-a-number stands for null."""
    out = np.where(t == np.inf, 0.0, np.where(t == -np.inf, 1.0, np.nan))
    out[df < 1] = np.nan
    at = np.flatnonzero(np.isfinite(t) & (df >= 1))
    t, df = t[at], df[at].astype(float)
    wide = beta_share_of(df / 2, np.full(len(at), 0.5), df / (df + t * t)) / 2
    out[at] = np.where(t >= 0, wide, 1 - wide)
    return out


def normal_tail_of(z: np.ndarray) -> np.ndarray:
    """`normal_tail`; not-a-number stands for null."""
    x = np.abs(z)
    out = np.where(x > 39, np.where(z > 0, 0.0, 1.0), np.nan)
    for at, close in ((np.flatnonzero(x < 2.5), True), (np.flatnonzero((x >= 2.5) & (x <= 39)), False)):
        y = x[at]
        density = np.exp(-y * y / 2) / math.sqrt(2 * math.pi)
        if close:
            term = whole = y
            for n in range(1, 61):
                term = term * y * y / (2.0 * n + 1)
                whole = whole + term
            tail = 0.5 - density * whole
        else:
            below = y
            for n in range(100, 0, -1):
                below = y + n / below
            tail = density / below
        out[at] = np.where(z[at] >= 0, tail, 1 - tail)
    return out
