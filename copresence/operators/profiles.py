"""Half-hour activity profiles, record weights and cluster statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from copresence.functions.time_bins import profile_range

BINS = 48


def _profile_bins(stops: DataFrame, start_unit: str = "hours") -> DataFrame:
    lo, hi = profile_range(F.col("h_s"), F.col("dur"), start_unit=start_unit)
    return stops.withColumn("half_hour", F.explode(F.sequence(lo, hi))).withColumn("half_hour", F.pmod("half_hour", F.lit(BINS)))


def tempo(stops: DataFrame, by: list[str], norm: bool = False) -> DataFrame:
    """Stays per half hour of the day; every key gets all 48 bins."""
    counted = _profile_bins(stops.select(*by, "h_s", "dur")).groupBy(*by, "half_hour").agg(F.count(F.lit(1)).alias("freq"))
    out = fill_bins(counted, by, {"freq": 0})
    if norm:
        key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        out = out.withColumn("freq", F.col("freq") / F.max("freq").over(key))
    return out


def fill_bins(df: DataFrame, by: list[str], zero: dict[str, float], first: int = 0, name: str = "half_hour") -> DataFrame:
    """Complete the bins of every key with a zero row."""
    if by:
        keys = df.select(*by).distinct()
    else:
        keys = df.sparkSession.range(1).select(F.lit(0).alias("_all"))
    frame = keys.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(first + BINS - 1))))
    return frame.join(df, [*by, name], "left").fillna(zero).drop("_all")


def activity_profiles(stops: DataFrame) -> DataFrame:
    """All stays, holiday stays and other stays, in one pass over the data."""
    return (
        _profile_bins(stops.select("h_s", "dur", "holiday"))
        .withColumn("activity", F.explode(F.array(F.lit("all"), F.when(F.col("holiday") == 1, "holiday").otherwise("non_holiday"))))
        .groupBy("activity", "half_hour").agg(F.count(F.lit(1)).alias("freq"))
        .transform(lambda d: fill_bins(d, ["activity"], {"freq": 0}))
    )


def tempo_weighted(stops: DataFrame, by: list[str], wt: str = "wt", start_unit: str = "hours") -> DataFrame:
    """Peak-scaled profile by count and by weight."""
    counted = _profile_bins(stops.select(*by, "h_s", "dur", wt), start_unit).groupBy(*by, "half_hour").agg(
        F.count(F.lit(1)).alias("freq"), F.sum(wt).alias("freq_wt"))
    key = Window.partitionBy(*by)  # at most 48 rows per key
    return fill_bins(counted, by, {"freq": 0, "freq_wt": 0.0}).withColumns({
        "freq": F.col("freq") / F.max("freq").over(key), "freq_wt": F.try_divide(F.col("freq_wt"), F.max("freq_wt").over(key))})


def record_weights(stops: DataFrame, by: list[str], start_unit: str = "hours") -> DataFrame:
    """Add `wt`: the inverse of the peak-scaled profile summed over the bins of a stay inside its first day.

    The profile travels as one 48-number array per key, so a stay is weighted without being exploded again.
    """
    profile = _profile_bins(stops.select(*by, "h_s", "dur"), start_unit).groupBy(*by, "half_hour").agg(
        F.count(F.lit(1)).alias("n"))
    cells = F.map_from_entries(F.collect_list(F.struct("half_hour", "n")))
    arrays = profile.groupBy(*by).agg(F.max("n").alias("_peak"), cells.alias("_cells"))
    inverse = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)),
                          lambda b: F.coalesce(F.try_divide(F.col("_peak").cast("double"), F.try_element_at("_cells", b)), F.lit(0.0)))
    arrays = arrays.select(*by, inverse.alias("_inv"))
    lo, hi = profile_range(F.col("h_s"), F.col("dur"), start_unit=start_unit)
    if by:
        out = stops.join(arrays, by)
    else:
        out = stops.withColumn("_inv", arrays.scalar())
    covered = F.slice(F.col("_inv"), lo + 1, F.greatest(F.least(hi, F.lit(BINS - 1)) - lo + 1, F.lit(0)))
    return out.withColumn("wt", F.aggregate(covered, F.lit(0.0), lambda acc, v: acc + v)).drop("_inv")


def cluster_stats(stops: DataFrame) -> DataFrame:
    return stops.groupBy("uid", "loc", "holiday").agg(
        F.count(F.lit(1)).alias("freq"), F.sum("wt").alias("freq_wt"), F.sum("dur").alias("dur"))


def top_clusters(clusters: DataFrame, k: int = 3) -> DataFrame:
    """The k heaviest non-holiday clusters of a person; a person's clusters are pre-summed, one row per place."""
    order = Window.partitionBy("uid").orderBy(F.desc("freq_wt"), "loc")
    return clusters.where("holiday = 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
