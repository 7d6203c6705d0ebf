"""Mobility measures of a person and distance decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copresence.functions.distance import haversine, planar
from copresence.operators import ordered, quantiles


def path_length(stops: DataFrame, slot: str, order: list[str]) -> DataFrame:
    """Sum of straight lines between consecutive stays and the number of stays, per person."""
    steps = ordered.previous(stops.select("uid", "lat", "lng", *dict.fromkeys([slot, *order])), ["uid"], slot, order, ["lat", "lng"])
    d = haversine(F.col("prev_lng"), F.col("prev_lat"), F.col("lng"), F.col("lat"))
    return steps.groupBy("uid").agg(F.sum(d).alias("distance"), F.count(F.lit(1)).alias("number_of_visits"))


def mobility_metrics(stops: DataFrame, home: DataFrame, slot: str, order: list[str]) -> DataFrame:
    """Locations, visits, mean displacement, radius of gyration and median distance to home.

    Distances depend only on (person, place), so both use place counts instead of single stays.
    """
    spots = stops.groupBy("uid", "lat", "lng").agg(F.count(F.lit(1)).alias("n"))
    centre = spots.groupBy("uid").agg(
        (F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("clat"), (F.sum(F.col("lng") * F.col("n")) / F.sum("n")).alias("clng"),
        F.count(F.lit(1)).alias("number_of_locations"))
    spread = haversine(F.col("clng"), F.col("clat"), F.col("lng"), F.col("lat"))
    gyration = spots.join(centre, "uid").groupBy("uid").agg(
        F.sqrt(F.sum(F.col("n") * spread * spread) / F.sum("n")).alias("radius_of_gyration"),
        F.first("number_of_locations").alias("number_of_locations"))
    to_home = haversine(F.col("home_lng"), F.col("home_lat"), F.col("lng"), F.col("lat"))
    homeward = spots.join(home.select("uid", "home_lat", "home_lng"), "uid").select("uid", "n", to_home.alias("d"))
    near = quantiles.quantiles(homeward, ["uid"], "d", [0.5], n="n").select("uid", F.col("value").alias("median_distance_from_home"))
    path = path_length(stops, slot, order).withColumn(
        "average_displacement", F.try_divide(F.col("distance"), F.col("number_of_visits") - 1)).drop("distance")
    return path.join(gyration, "uid").join(near, "uid")


def distance_decay(visits: DataFrame, dist: str, w: str, by: list[str], top: int = 1500) -> DataFrame:
    """Weighted share of visits by whole km of distance, bins (d-1, d]."""
    inside = visits.where((F.col(dist) > 0) & (F.col(dist) <= top)).withColumn("d", F.ceil(dist).cast("int"))
    cells = inside.groupBy(*by, "d").agg(F.sum(w).alias("_w"))
    return share_within(cells, by, "_w", "fd").drop("_w")


def share_within(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Each row's part of its group's total; the total is summed apart and joined, so hot groups stay spread."""
    if not by:
        return df.withColumn(name, F.col(value) / df.agg(F.sum(value)).scalar())
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return df.join(totals, by).withColumn(name, F.try_divide(F.col(value).cast("double"), F.col("_total"))).drop("_total")


def d2h_by_type(visits: DataFrame, homes: DataFrame, people: DataFrame, kind: str = "poi_type", place: str = "osm_id") -> DataFrame:
    """Distance from home to visited places by place type and group: weighted quartiles, mean and distinct places."""
    d = planar(F.col("x"), F.col("y"), F.col("hx"), F.col("hy"))
    met = visits.where(F.col(kind).isNotNull()).join(homes, "uid").join(people, "uid").select(kind, "grp_r", place, "wt_p", d.alias("d2h"))
    met = met.dropna(subset=["d2h"])
    places = met.select(kind, "grp_r", place).distinct().groupBy(kind, "grp_r").agg(F.count(F.lit(1)).alias("places"))
    return quantiles.group_stats(met, [kind, "grp_r"], "d2h", "wt_p").join(places, [kind, "grp_r"])
