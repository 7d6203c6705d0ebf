"""Home-grid aggregates and joins that enrich visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copresence.operators import ordered, quantiles


def enrich_visits(visits: DataFrame, persons: DataFrame, grids: DataFrame, access: DataFrame, zone: str) -> DataFrame:
    """Visits with person, home grid and access attributes; visits without a match keep nulls."""
    people = persons.join(grids, zone, "left").join(access, zone, "left")
    return visits.join(people, "uid", "left")


def backfill(df: DataFrame, coarse: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Missing attributes from a coarser table."""
    spare = coarse.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return df.join(spare, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in cols}).drop(*[f"_{c}" for c in cols])


def align(parts: list[DataFrame], key: str) -> DataFrame:
    """Columns of several tables side by side on a key."""
    out = parts[0]
    for df in parts[1:]:
        out = out.join(df, key, "full")
    return out


def grid_day(exposure: DataFrame, zone: str, w: str, name: str) -> DataFrame:
    """Weighted median per grid and half hour, then the plain median over the half hours of a day type."""
    cell = [zone, "weekday", "holiday", "time_seq"]
    counts = exposure.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("n_wt"))
    cuts = ordered.split_points(exposure, "ice_birth", 16)
    mids = quantiles.wquantile_interp(exposure, cell, "ice_birth", w, [0.5], cuts).select(*cell, F.col("value").alias("ice"))
    halves = counts.join(mids, cell)
    mid = lambda c: F.median(c)  # noqa: E731 - at most 48 half hours per group
    return halves.groupBy(zone, "weekday", "holiday").agg(
        mid("n").alias(f"ind_count_{name}"), mid("n_wt").alias(f"ind_count_wt_{name}"), mid("ice").alias(f"ice_birth_{name}"),
        F.count(F.lit(1)).alias(f"time_seq_count_{name}"))


def grid_features(levels: dict[str, DataFrame], zone: str, w: str) -> DataFrame:
    """Day aggregates at several spatial resolutions, joined to the first one."""
    out = None
    for name, exposure in levels.items():
        day = grid_day(exposure, zone, w, name)
        out = day if out is None else out.join(day, [zone, "weekday", "holiday"], "left")
    return out


def sample_people(df: DataFrame, uid: str, n: int, u) -> DataFrame:
    """All rows of n people, picked by the smallest draw; draws depend on the person only."""
    picked = df.select(uid).distinct().orderBy(u, uid).limit(n)
    return df.join(picked, uid, "left_semi")


def bucket(df: DataFrame, uid: str, n: int, seed: int = 0, name: str = "gp") -> DataFrame:
    """Seeded group of a person."""
    return df.withColumn(name, F.pmod(F.xxhash64(uid, F.lit(seed)), F.lit(n)))
