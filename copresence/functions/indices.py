"""Segregation indices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def evenness(parts: list[Column]) -> Column:
    """Unevenness over n groups: n/(2n-2) times the summed distance of shares from 1/n."""
    n = len(parts)
    total = sum(parts[1:], parts[0])
    gaps = [F.abs(F.try_divide(p, total) - 1.0 / n) for p in parts]
    return F.lit(n / (2.0 * n - 2.0)) * sum(gaps[1:], gaps[0])


def ice(a: Column, b: Column, total: Column, share_a=None, share_b=None) -> Column:
    """Concentration at the extremes, raw or relative to overall shares; null when nothing is there."""
    rest = total - a - b
    if share_a is None:
        return F.try_divide(a - b, total)
    share_rest = F.lit(1.0) - share_a - share_b
    pa, pb, po = a / share_a, b / share_b, rest / share_rest
    return F.try_divide(pa - pb, pa + pb + po)


def dissimilarity_term(share_a: Column, share_b: Column, pop: Column, total_a: Column, total_b: Column) -> Column:
    return F.abs(share_a * pop / total_a - share_b * pop / total_b)


def isolation_term(share: Column, pop: Column, total: Column, reverse: bool = False) -> Column:
    part = (1 - share) if reverse else share
    return part * part * pop / total


def signed_change(ice_r: Column, ice_e: Column) -> Column:
    """Change of exposure seen from the home side of the scale."""
    return F.when(ice_r < 0, ice_r - ice_e).otherwise(ice_e - ice_r)


def change_label(delta: Column) -> Column:
    """inc where the signed change is above zero, dec elsewhere; null stays null."""
    return F.when(delta > 0, "inc").when(delta.isNotNull(), "dec")
