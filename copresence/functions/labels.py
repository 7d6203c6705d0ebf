"""Category labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def group_r(ice: Column, low: float = -0.2, high: float = 0.2) -> Column:
    """Residential group: D above the upper threshold, F below the lower one, else N."""
    return F.when(ice > high, "D").when(ice < low, "F").when(ice.isNotNull(), "N")


def income_label(share: Column, low: float = 0.1, high: float = 0.4) -> Column:
    """Income group from the share of people in the lowest income quarter."""
    return F.when(share <= low, "High income").when(share > high, "Low income").when(share.isNotNull(), "Middle income")


def cut(x: Column, edges: list[float], names: list[str], include_lowest: bool = False) -> Column:
    """Bins (a, b] with labels; null outside."""
    out = F.lit(None).cast("string")
    for i in reversed(range(len(names))):
        lo, hi = edges[i], edges[i + 1]
        above = (x >= lo) if include_lowest and i == 0 else (x > lo)
        out = F.when(above & (x <= hi), names[i]).otherwise(out)
    return out


def tag_tier(a: Column, b: Column) -> Column:
    """Similarity of two place tags, 1 closest to 4, 0 none."""
    family_a, family_b = F.split(a, r" \(")[0], F.split(b, r" \(")[0]
    both = F.contains(a, F.lit("(")) & F.contains(b, F.lit("("))
    trade = F.lit("Office"), F.lit("Craft")
    shop = lambda t: F.contains(t, F.lit("(s)")) | (t == "Shop")
    return (
        F.when(a == b, 1).when(both & (family_a == family_b), 2)
        .when(a.isin(*trade) & b.isin(*trade), 3).when(shop(a) & shop(b), 4).otherwise(0)
    )


def effect_size(d: Column) -> Column:
    """Size word of a standardised difference; cut points .2, .5, .8."""
    m = F.abs(d)
    return F.when(m < 0.2, "Very small").when(m < 0.5, "Small").when(m < 0.8, "Medium").when(m.isNotNull(), "Large")
