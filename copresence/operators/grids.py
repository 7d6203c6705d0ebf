"""Population grid cells of two sizes: duplicates, overlap and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _merged(df: DataFrame, keys: list[str], sums: list[str], mean: str | None, weight: str | None) -> DataFrame:
    """Summed counts; the income median becomes a population-weighted mean, or a plain sum in an empty cell."""
    aggs = [F.sum(c).alias(c) for c in sums]
    if mean is not None:
        weighted = F.try_divide(F.sum(F.col(mean) * F.col(weight)), F.sum(weight))
        aggs.append(F.when(F.sum(F.when(F.col(weight) == 0, 1).otherwise(0)) > 0, F.coalesce(weighted, F.lit(0.0)))
                    .otherwise(weighted).alias(mean))
    return df.groupBy(*keys).agg(*aggs)


def merge_duplicate_cells(cells: DataFrame, cell: str, size: str, sums: list[str], large: int, mean: str | None = None,
                          weight: str | None = None) -> DataFrame:
    """One row per cell id; an id given in both sizes becomes one large cell, other ids stay as they are."""
    many = cells.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(cell)
    value = [*sums, *([mean] if mean else [])]
    single = cells.join(many, cell, "left_anti").select(cell, size, *value)
    twice = cells.join(many, cell, "left_semi")
    holders = twice.where(F.col(size) == large).select(cell).distinct()
    merged = _merged(twice, [cell], sums, mean, weight).join(holders, cell).withColumn(size, F.lit(large))
    return single.unionByName(merged.select(cell, size, *value))


def fold_cells(cells: DataFrame, cell: str, size: str, host: str, sums: list[str], large: int, mean: str, weight: str):
    """Fold small cells into the large cell that holds them, where that large cell exists; others stay.

    `host` names the large cell a small cell lies in.
    """
    big = cells.where(F.col(size) == large)
    small = cells.where(F.col(size) != large)
    hosts = big.select(F.col(cell).alias(host)).distinct()
    inside = small.join(hosts, host, "left_semi")
    outside = small.join(hosts, host, "left_anti")
    used = inside.select(F.col(host).alias(cell)).distinct()
    value = [*sums, mean]
    pooled = inside.select(F.col(host).alias(cell), *value).unionByName(big.join(used, cell, "left_semi").select(cell, *value))
    folded = _merged(pooled, [cell], sums, mean, weight).withColumn(size, F.lit(large))
    kept = outside.unionByName(big.join(used, cell, "left_anti"))
    return kept.select(cell, size, *value).unionByName(folded.select(cell, size, *value))


def grid_overlap(base: DataFrame, others: dict[str, DataFrame], cell: str) -> DataFrame:
    """How many base cells also occur in each other grid."""
    row = base.agg(F.count(F.lit(1)).alias("total"))
    for name, df in others.items():
        shared = base.join(df.select(cell), cell, "left_semi").agg(F.count(F.lit(1))).scalar()
        row = row.withColumn(name, shared)
    return row


def grid_shares(cells: DataFrame, size: str, total: str, small: int) -> DataFrame:
    """Share of small cells, of non-empty cells and of people in small cells, in percent."""
    is_small = F.col(size) == small
    return cells.agg(
        (F.avg(is_small.cast("int")) * 100).alias("small_cells"), (F.avg((F.col(total) != 0).cast("int")) * 100).alias("nonempty"),
        (F.sum(F.when(is_small, F.col(total)).otherwise(0)) / F.sum(total) * 100).alias("people_in_small"))


def car_ownership(cars: DataFrame, zones: DataFrame, key: str, n: str, pop: str) -> DataFrame:
    return cars.join(zones.select(key, pop), key).select(key, F.try_divide(F.col(n).cast("double"), F.col(pop)).alias("car_ownership"))
