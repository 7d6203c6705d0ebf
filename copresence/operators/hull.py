"""Convex hulls of groups of shapes, what lies within a distance of them, and the origins and destinations of a county."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from copresence.functions.distance import in_polygon

_RING = "ring array<struct<x:double,y:double>>"


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the lowest left one; points on an edge are no corners."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(ordered: np.ndarray) -> list:
        chain: list = []
        for p in ordered.tolist():
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(points) + half(points[::-1]))


def _corners(ring) -> np.ndarray:
    return np.array([[p["x"], p["y"]] for p in ring], dtype=float).reshape(-1, 2)


def hulls(shapes: DataFrame, by: list[str], ring: str = "ring") -> DataFrame:
    """The convex hull of all rings of a group: by, ring.

    Hulls merge: the hull of hulls is the hull of all. Every task first reduces what it holds of a group to one hull, so that only corners of
    partial hulls meet in a group, however many shapes it has.
    """
    fields = "".join(f"`{c}` {shapes.schema[c].dataType.simpleString()}, " for c in by)

    def rows(keys: tuple, hull: np.ndarray) -> dict:
        return {**dict(zip(by, keys)), "ring": [{"x": float(x), "y": float(y)} for x, y in hull]}

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k if isinstance(k, tuple) else (k,), hull_of(np.vstack([_corners(r) for r in part["ring"]]))) for k, part in frame.groupby(by, dropna=False)]
            if found:
                yield pd.DataFrame([rows(k, hull) for k, hull in found])

    def whole(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([rows(key, hull_of(np.vstack([_corners(r) for r in parts["ring"]])))])

    some = shapes.where(F.size(ring) > 0).select(*by, F.col(ring).alias("ring")).mapInPandas(partial, fields + _RING)
    return some.groupBy(*by).applyInPandas(whole, fields + _RING)


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to the nearest edge of a closed ring."""
    def edge(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % F.size(ring) + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        along = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        return F.sqrt(F.pow(x - a["x"] - along * dx, F.lit(2)) + F.pow(y - a["y"] - along * dy, F.lit(2)))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(ring)), edge))


def shape_distance(x: Column, y: Column, ring: Column) -> Column:
    """0 inside a ring, else the distance to its nearest edge."""
    return F.when((F.size(ring) > 2) & in_polygon(x, y, ring), 0.0).otherwise(ring_distance(x, y, ring))


def within_buffer(points: DataFrame, shapes: DataFrame, by: list[str], buffer: float, cell: float, same: list[str] | None = None) -> DataFrame:
    """Points (x, y) within `buffer` of the shapes (by, ring), with the shape's columns; `same` names columns that must be equal on both sides.

    A shape and its buffer are covered by square cells. Cells that lie inside as a whole settle their points; only points in cells on
    the border are measured. The ring stands in one row a shape and border cell, never beside a point of an inner cell.
    """
    same = same or []
    reach, slack = buffer + cell * 2 ** -0.5, cell * 2 ** -0.5
    ends = lambda c: F.sequence(F.floor((F.array_min(F.transform("ring", lambda p: p[c])) - buffer) / cell),
                                F.floor((F.array_max(F.transform("ring", lambda p: p[c])) + buffer) / cell))
    middle = lambda c: (F.col(c) + 0.5) * cell
    keys = list(dict.fromkeys([*by, *same]))
    cover = shapes.select(*keys, "ring", F.explode(ends("x")).alias("_cx"), ends("y").alias("_ys")).select(*keys, "ring", "_cx", F.explode("_ys").alias("_cy"))
    cover = cover.withColumn("_away", shape_distance(middle("_cx"), middle("_cy"), F.col("ring"))).where(F.col("_away") <= reach)
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    inner = cover.where(F.col("_away") <= buffer - slack).select(*keys, "_cx", "_cy")
    border = cover.where(F.col("_away") > buffer - slack).select(*keys, "_cx", "_cy", "ring")
    on = [*same, "_cx", "_cy"]
    near = placed.join(border, on).where(shape_distance(F.col("x"), F.col("y"), F.col("ring")) <= buffer).drop("ring")
    return placed.join(inner, on).unionByName(near).drop("_cx", "_cy")


def county_destinations(zones: DataFrame, grids: DataFrame, buffer: float, sizes: list[float], county: str = "county", cell: float = 10_000.0) -> DataFrame:
    """Grid squares with jobs that touch the buffered hull of a county's zones: county, cell_id, x, y, job.

    `grids` has cell_id, the centre x and y, the side `size` (one of `sizes`) and job. A square touches a convex shape where its centre lies in
    the shape widened by half a square, so there is one hull for each size.
    """
    wide = zones.select(county, "ring", F.explode(F.array(*[F.lit(float(s)) for s in sizes])).alias("size"))
    at = lambda p, dx, dy: F.struct((p["x"] + dx * F.col("size") / 2).alias("x"), (p["y"] + dy * F.col("size") / 2).alias("y"))
    wide = wide.withColumn("ring", F.flatten(F.transform("ring", lambda p: F.array(*[at(p, dx, dy) for dx in (-1, 1) for dy in (-1, 1)]))))
    jobs = grids.where("job > 0").withColumn("size", F.col("size").cast("double"))
    return within_buffer(jobs, hulls(wide, [county, "size"]), [county], buffer, cell, ["size"]).select(county, "cell_id", "x", "y", "job")


def county_origins(homes: DataFrame, grids: DataFrame, county: str = "county") -> DataFrame:
    """Grid squares in which somebody of a county lives: county, cell_id, x, y. A square belongs to its first county only."""
    first = homes.groupBy("cell_id").agg(F.min(county).alias(county))
    return grids.select("cell_id", "x", "y").join(first, "cell_id").select(county, "cell_id", "x", "y")
