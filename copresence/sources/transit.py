"""Cleaning of transit feeds and pooling of accessibility results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def clean_gtfs(tables: dict[str, DataFrame], recode: dict[int, int] | None = None) -> dict[str, DataFrame]:
    """Drop shapes of one point, stops at zero coordinates with every trip that calls there, and recode route types."""
    out = dict(tables)
    if "shapes" in out:
        lone = out["shapes"].groupBy("shape_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
        out["shapes"] = out["shapes"].join(lone, "shape_id", "left_anti")
    bad = out["stops"].where((F.col("stop_lat") == 0) | (F.col("stop_lon") == 0)).select("stop_id")
    bad_trips = out["stop_times"].join(bad, "stop_id", "left_semi").select("trip_id").distinct()
    out["stops"] = out["stops"].join(bad, "stop_id", "left_anti")
    for name in ("stop_times", "trips"):
        if name in out:
            out[name] = out[name].join(bad_trips, "trip_id", "left_anti")
    if "routes" in out:
        kind = F.col("route_type")
        for old, new in (recode or {1501: 3}).items():
            kind = F.when(F.col("route_type") == old, new).otherwise(kind)
        out["routes"] = out["routes"].withColumn("route_type", kind)
    return out


def read_access(spark: SparkSession, glob: str) -> DataFrame:
    """All accessibility result files of a folder pattern."""
    return spark.read.schema("id string, accessibility double").option("header", True).csv(glob)


def person_access(results: DataFrame, home: DataFrame, cell: str, name: str) -> DataFrame:
    """One value per cell over all files (the largest on overlap), attached to the people who live there."""
    per_cell = results.groupBy(F.col("id").alias(cell)).agg(F.max("accessibility").alias(name))
    return home.join(per_cell, cell, "left")
