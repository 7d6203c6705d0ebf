"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

PINGS = "timestamp bigint, device_aid string, latitude double, longitude double, location_method string"
PINGS_XY = "timestamp int, device_aid string, latitude double, longitude double, utm_x double, utm_y double"
STOP_POINTS = ("loc int, timestamp int, interval int, latitude double, longitude double, device_aid string, "
               "stop_latitude double, stop_longitude double")
DELTAS = "device_aid string, timestamp int, xDelta double, yDelta double, tDelta int, displacement double"
STAYS = "device_aid string, interval bigint, loc int, start bigint, end bigint, latitude double, longitude double, size bigint"
ZONES = "deso string, ring array<struct<x:double,y:double>>"
GTFS = {
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "routes": "route_id string, route_type int",
    "trips": "route_id string, trip_id string, shape_id string",
    "stop_times": "trip_id string, stop_id string, stop_sequence int",
}


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail early when a table lacks columns an operator needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
