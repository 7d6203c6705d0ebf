"""Seeded draws: functions of row keys, never of partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_SPAN = 1 << 52


def uniform(keys: list[Column], seed: int) -> Column:
    """A number strictly between 0 and 1."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(_SPAN)).cast("double") + 0.5) / float(_SPAN)


def position(u: Column, size: Column) -> Column:
    """A position between 1 and size from a uniform number."""
    return F.least(F.floor(u * size) + 1, size)


def poisson_one(u: Column) -> Column:
    """Poisson count with mean 1 by inversion; counts rarer than the resolution of `u` cannot occur."""
    steps, total, p, k = [], 0.0, math.exp(-1), 0
    while p > 1 / _SPAN:
        total += p
        steps.append(total)
        k += 1
        p /= k
    out = F.lit(k)
    for i in reversed(range(k)):
        out = F.when(u <= steps[i], i).otherwise(out)
    return out


#: A draw of a larger mean is the sum of draws of at most this mean.
_MEAN = 16.0


@F.pandas_udf(T.IntegerType())
def poisson(rate: pd.Series, u: pd.Series) -> pd.Series:
    """Poisson count per row and any mean: the sum of independent draws of bounded mean, each by inversion of a number hashed from
    the row's uniform number and the draw's position."""
    left, seed = rate.to_numpy(float).copy(), u.to_numpy(float).view(np.uint64)
    count, nth = np.zeros(len(left), dtype=np.int64), 0
    rows = np.flatnonzero(left > 0)
    while len(rows):
        count[rows] += _inverted(np.minimum(left[rows], _MEAN), _hashed(seed[rows], nth))
        left[rows] -= _MEAN
        rows, nth = rows[left[rows] > 0], nth + 1
    return pd.Series(count.astype(np.int32))


def _hashed(seed: np.ndarray, nth: int) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    with np.errstate(over="ignore"):
        x = seed + np.uint64((nth + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(float) / _SPAN + 0.5 / _SPAN


def _inverted(mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    count, p = np.zeros(len(mean), dtype=np.int64), np.exp(-mean)
    total, k = p.copy(), 0
    live = q > total
    while live.any():
        k += 1
        p = p * mean / k
        count[live] += 1
        total = total + p
        live &= (q > total) & ((k < mean) | (p > 0.1 / _SPAN))  # nothing rarer can be told apart
    return count


def hashed_uniform(keys: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Numbers strictly between 0 and 1, a row of n for each key, from key, place and seed only."""
    base, step = _bases(keys, n, seed)
    with np.errstate(over="ignore"):
        x = base[:, None] + step
        _mix(x, np.empty_like(x))
    return _between(x)


def _bases(keys: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        base = keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        _mix(base, np.empty_like(base))
        return base, np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """Mixes the bits of x in place."""
    _mix_lead(x, spare)
    np.right_shift(x, np.uint64(31), out=spare)
    np.bitwise_xor(x, spare, out=x)


def _mix_lead(x: np.ndarray, spare: np.ndarray) -> None:
    """All of `_mix` but its last step, which leaves the 31 leading bits as they are."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint64(factor), out=x)


def _between(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(12)).astype(float) / _SPAN + 0.5 / _SPAN


def poisson_quantile(means: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson counts of any mean by inversion: a row of counts for each mean. One table of running shares serves all rows of a mean."""
    out = np.zeros(u.shape, np.int64)
    values, which = np.unique(means, return_inverse=True)
    for i, mean in enumerate(values.tolist()):
        if mean > 0:
            rows = np.flatnonzero(which == i)
            low, shares = _poisson_table(mean)
            out[rows] = low + np.searchsorted(shares, u[rows])
    return out


def _poisson_table(mean: float) -> tuple[int, np.ndarray]:
    """The first count worth telling apart, and the running shares from it on."""
    reach = 12 * math.sqrt(mean) + 30
    low = max(0, int(mean - reach))
    k = np.arange(low, int(mean + reach) + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))]) + math.lgamma(low + 1)
    return low, np.cumsum(np.exp(k * math.log(mean) - mean - logs))


#: Leading bits of a hashed number that name its bucket, numbers hashed at once, and the largest mean that has a table of buckets.
_BITS, _AT_ONCE, _LARGEST = 12, 65_536, 200.0


def hashed_poisson(keys: np.ndarray, means: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The counts that `poisson_quantile` gives for the numbers of `hashed_uniform`. Most follow from a number's leading bits alone; only numbers
    of buckets that hold a step of the running shares are compared with them."""
    values, which = np.unique(means, return_inverse=True)
    if not len(values) or not 0 < values[0] <= values[-1] <= _LARGEST or 2 * len(values) > len(means):
        return poisson_quantile(means, hashed_uniform(keys, n, seed))
    base, step = _bases(keys, n, seed)
    out, size = np.empty((len(keys), n), np.int16), max(1, _AT_ONCE // n)
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which))
    # filled again for every share of the rows: fresh arrays of this size cost more than the arithmetic
    numbers, spares = np.empty((2, size, n), np.uint64)
    counts = np.empty((size, n), np.int16)
    for mean, end, many in zip(values.tolist(), ends, np.bincount(which)):
        buckets, low, shares = _buckets(mean)
        for at in range(end - many, end, size):
            rows = order[at:min(at + size, end)]
            x, lead, found = numbers[:len(rows)], spares[:len(rows)], counts[:len(rows)]
            with np.errstate(over="ignore"):
                np.add(base[rows, None], step, out=x)
                _mix_lead(x, lead)
            np.right_shift(x, np.uint64(64 - _BITS), out=lead)
            np.take(buckets, lead.view(np.int64), mode="clip", out=found)
            several = np.flatnonzero(found < 0)
            rest = x.reshape(-1)[several]
            found.reshape(-1)[several] = low + np.searchsorted(shares, _between(rest ^ (rest >> np.uint64(31))))
            out[rows] = found
    return out


@lru_cache(1024)
def _buckets(mean: float) -> tuple[np.ndarray, int, np.ndarray]:
    """The count of every bucket of numbers, -1 where a bucket has several, and the table of running shares."""
    low, shares = _poisson_table(mean)
    lead = np.arange(1 << _BITS, dtype=np.uint64) << np.uint64(64 - _BITS)
    first, last = (low + np.searchsorted(shares, _between(lead + np.uint64(i))) for i in (0, (1 << (64 - _BITS)) - 1))
    return np.where(first == last, first, -1).astype(np.int16), low, shares


def binomial_quantile(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Counts of hits among n tries by inversion, for one chance p strictly between 0 and 1; one table serves all rows of an n."""
    out = np.zeros(len(n), np.int64)
    values, which = np.unique(n, return_inverse=True)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(values.max(initial=0)) + 1)))])
    for i, tries in enumerate(values.tolist()):
        reach = 12 * math.sqrt(tries * p * (1 - p)) + 30
        low = max(0, int(tries * p - reach))
        k = np.arange(low, min(tries, int(tries * p + reach)) + 1)
        shares = np.cumsum(np.exp(logs[tries] - logs[k] - logs[tries - k] + k * math.log(p) + (tries - k) * math.log1p(-p)))
        rows = np.flatnonzero(which == i)
        out[rows] = np.minimum(low + np.searchsorted(shares, u[rows]), tries)
    return out


def multinomial_tree(n: int, shares: np.ndarray, uniforms: Callable[[np.ndarray, int], np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n draws for each key, as counts: (row, bin, count) of all bins that were drawn.

    The draws of a node of the tree over bins are split between its halves by one binomial count, so a key costs the number of
    bins and not of draws. Nodes are numbered from 1 as in a heap; `uniforms` gives a row's number of a node.
    """
    upto = np.concatenate([[0.0], np.cumsum(shares)])
    todo = [(1, 0, len(shares), np.arange(len(keys)), np.full(len(keys), n, np.int64))]
    found = []
    while todo:
        node, lo, hi, rows, count = todo.pop()
        if hi - lo == 1:
            found.append((rows, np.full(len(rows), lo), count))
            continue
        mid = (lo + hi) // 2
        left = binomial_quantile(count, (upto[mid] - upto[lo]) / (upto[hi] - upto[lo]), uniforms(keys[rows], node))
        for child, a, b, part in ((2 * node, lo, mid, left), (2 * node + 1, mid, hi, count - left)):
            if (part > 0).any():
                todo.append((child, a, b, rows[part > 0], part[part > 0]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
