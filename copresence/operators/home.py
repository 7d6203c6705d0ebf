"""Home detection and device weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copresence.operators import quantiles


def home_scores(tempo: DataFrame) -> DataFrame:
    """Night weight and its share in percent per (uid, loc); night is bins 0-11 and 44-47."""
    night = (F.col("half_hour") <= 11) | (F.col("half_hour") >= 44)
    return tempo.groupBy("uid", "loc").agg(
        F.sum(F.when(night, F.col("freq_wt")).otherwise(0.0)).alias("home_freq"), F.sum("freq_wt").alias("_all"),
    ).select("uid", "loc", "home_freq", (F.try_divide(F.col("home_freq"), F.col("_all")) * 100).alias("home_share"))


def pick_home(scores: DataFrame) -> DataFrame:
    """Heaviest place at night per person, lowest place id on ties; persons without night weight drop out."""
    best = F.max_by(F.struct("loc", "home_freq", "home_share"), F.struct("home_freq", -F.col("loc")))
    return scores.where("home_freq > 0").groupBy("uid").agg(best.alias("b")).select(
        "uid", F.col("b.loc").alias("home"), "b.home_freq", "b.home_share")


def reliable_home(home: DataFrame, least: int = 3) -> DataFrame:
    return home.where(F.col("freq") >= least)


def device_weights(home: DataFrame, zones: DataFrame, zone: str = "deso", pop: str = "pop") -> DataFrame:
    """Population over devices by zone, trimmed at 3.5 * median * sqrt(cv^2 + 1) over zones that hold devices."""
    raw = (
        home.groupBy(zone).agg(F.count(F.lit(1)).alias("devices")).join(zones.select(zone, pop), zone)
        .withColumn("wt_raw", F.col(pop) / F.col("devices"))
    )
    spread = raw.agg(F.stddev_pop("wt_raw").alias("sd"), F.avg("wt_raw").alias("mean"))
    mid = quantiles.median(raw, [], "wt_raw", "mid", cuts=[])  # one row per zone
    cut = F.sqrt(F.pow(F.col("sd") / F.col("mean"), 2) + 1) * 3.5
    factor = spread.select(cut).scalar() * mid.scalar()
    return raw.withColumn("wt_cut", factor).select(
        zone, "devices", "wt_raw", "wt_cut", F.least("wt_raw", "wt_cut").alias("wt_p"))


def coverage(home: DataFrame, zones: DataFrame, zone: str = "deso", pop: str = "pop") -> DataFrame:
    """Devices per zone and share of the population sampled; zones without devices count as zero."""
    devices = home.groupBy(zone).agg(F.count(F.lit(1)).alias("devices"))
    return zones.select(zone, pop).join(devices, zone, "left").fillna({"devices": 0}).withColumn(
        "share", F.try_divide(F.col("devices"), F.col(pop)) * 100)
