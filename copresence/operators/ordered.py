"""Per-key sequences that stay balanced when one key holds a large part of the rows.

A plain window over a key sorts the whole key in one task. Here each key is cut into slots along its order
(an hour, a day); windows run inside (key, slot), and a small table with one row per (key, slot) carries what
the next slot needs. Group sizes are then bounded by the slot, and the carry table by the number of slots.
`slot` must be a function of the leading order column, so that slots follow each other in order.

Where no key is crowded, `slot` may be None: a key is then one group, and steps over the same key and order share a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from copresence.session import cut

#: Rows of a key that one task may sort.
MOST = 100_000


def sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))


def crowded(groups: DataFrame, by: list[str], most: int = MOST) -> DataFrame | None:
    """The keys of `groups` (by, size) with more rows than `most`, as a stored table; None where there are none."""
    found = cut(groups.where(F.col("size") > most).select(*by))
    return found if found.take(1) else None


def _parts(by: list[str], slot: str, order: list[str]):
    return Window.partitionBy(*by, slot).orderBy(*order), Window.partitionBy(*by).orderBy(slot)


def _whole(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def _beside(df: DataFrame, row: Column, cols: list[str], prefix: str) -> DataFrame:
    out = df.withColumn("_near", row)
    return out.withColumns({prefix + c: out["_near"][c] for c in cols}).drop("_near")


def previous(df: DataFrame, by: list[str], slot: str | None, order: list[str], cols: list[str], prefix: str = "prev_"):
    """Values of the row before, null on the first row of a key."""
    row = F.struct(*cols)
    if slot is None:
        return _beside(df, F.lag(row).over(_whole(by, order)), cols, prefix)
    inner, outer = _parts(by, slot, order)
    carry = (
        df.groupBy(*by, slot).agg(F.max_by(row, F.struct(*order)).alias("_edge"))
        .select(*by, slot, F.lag("_edge").over(outer).alias("_carry"))
    )
    out = df.withColumn("_near", F.lag(row).over(inner)).join(carry, [*by, slot])
    picked = F.coalesce("_near", "_carry")
    return out.withColumns({prefix + c: picked[c] for c in cols}).drop("_near", "_carry")


def following(df: DataFrame, by: list[str], slot: str | None, order: list[str], cols: list[str], prefix: str = "next_"):
    """Values of the row after, null on the last row of a key."""
    row = F.struct(*cols)
    if slot is None:
        return _beside(df, F.lead(row).over(_whole(by, order)), cols, prefix)
    inner, outer = _parts(by, slot, order)
    carry = (
        df.groupBy(*by, slot).agg(F.min_by(row, F.struct(*order)).alias("_edge"))
        .select(*by, slot, F.lead("_edge").over(outer).alias("_carry"))
    )
    out = df.withColumn("_near", F.lead(row).over(inner)).join(carry, [*by, slot])
    picked = F.coalesce("_near", "_carry")
    return out.withColumns({prefix + c: picked[c] for c in cols}).drop("_near", "_carry")


def running_sum(df: DataFrame, by: list[str], slot: str | None, order: list[str], value: Column, name: str) -> DataFrame:
    """Running total of `value`, this row included."""
    if slot is None:
        return df.withColumn(name, F.sum(value).over(_whole(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    inner, outer = _parts(by, slot, order)
    df = df.withColumn("_v", value)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*by, slot).agg(F.sum("_v").alias("_sum"))
        .select(*by, slot, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    )
    near = F.sum("_v").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_near", near).join(carry, [*by, slot])
    return out.withColumn(name, F.col("_near") + F.col("_carry")).drop("_v", "_near", "_carry")


def number(df: DataFrame, by: list[str], slot: str | None, order: list[str], name: str = "seq") -> DataFrame:
    """1-based position inside the key."""
    if slot is None:
        return df.withColumn(name, F.row_number().over(_whole(by, order)).cast("long"))
    inner, outer = _parts(by, slot, order)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*by, slot).agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, slot, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    )
    out = df.withColumn("_near", F.row_number().over(inner)).join(carry, [*by, slot])
    return out.withColumn(name, (F.col("_near") + F.col("_carry")).cast("long")).drop("_near", "_carry")


def split_points(df: DataFrame, col: str, parts: int = 64) -> list[float]:
    """At most parts-1 values that cut the column into pieces of about equal row count.

    One mergeable-sketch job; only the cut values reach the driver. They become literals of the plan, so every
    stage and every retry sees the same cuts. Results never depend on them, only the balance of the tasks does.
    """
    probs = [i / parts for i in range(1, parts)]
    cuts = df.select(F.col(col).cast("double").alias(col)).approxQuantile(col, probs, 0.25 / parts)
    return sorted(set(cuts))


def piece_of(x: Column, cuts: list[float]) -> Column:
    """Index of the piece a value falls in: a balanced tree of comparisons, kept inside code generation; for many cuts a search by batches."""
    if len(cuts) > 128:
        held = np.array(cuts)

        @F.pandas_udf("int")
        def place(x: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(held, x.to_numpy(float)).astype(np.int32))

        return place(x.cast("double"))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def cumulate(df: DataFrame, by: list[str], x: str, sums: dict[str, Column], cuts: list[float] | None = None):
    """Per distinct value of x inside a group: each sum at it, before it (`_lt`) and in total (`_all`).

    Rows are first summed to distinct values, then running sums are taken inside pieces of x and shifted by
    the sum of the pieces below, so no group is ever sorted whole.
    """
    cuts = split_points(df, x) if cuts is None else cuts
    names = list(sums)
    values = (
        df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(*[s.alias(n) for n, s in sums.items()])
        .withColumn("_piece", piece_of(F.col(x), cuts))
    )
    per_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = per_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        values.groupBy(*by, "_piece").agg(*[F.sum(n).alias(n) for n in names])
        .select(*by, "_piece",
                *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"_{n}_below") for n in names],
                *[F.sum(n).over(per_group).alias(f"{n}_all") for n in names])
    )
    inside = Window.partitionBy(*by, "_piece").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    near = values.withColumns({f"_{n}_near": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names})
    out = near.join(pieces, [*by, "_piece"])
    return out.select(*by, x, *names, *[(F.col(f"_{n}_near") + F.col(f"_{n}_below")).alias(f"{n}_lt") for n in names],
                      *[f"{n}_all" for n in names])
