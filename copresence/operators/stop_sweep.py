"""Stop detection for many settings of the longest silence in one pass.

Settings differ in two things: a gap longer than t_max closes the open group, and a silence is filled with one repeated ping t_max-1 s
later. So settings whose open groups are alike take the same steps until a gap treats them differently, and are
alike again when they open a group at the same point. A trace is therefore passed through once, with one state for each class of
settings that are alike; classes part at gaps and merge at steps (as a rule there is one class only).

The pass labels points. What follows works on stretches, runs of points of one class and group without a gap that concerns any setting:
sizes and spans of groups, their fills, and stays are sums over stretches, and medians are taken once for each distinct group,
whichever settings it belongs to.

Every step stays inside a device. Devices of few pings are dealt once and go through all steps where they lie, so that nothing but pings is
shuffled; crowded ones take the same steps as tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from copresence.functions.distance import haversine
from copresence.operators import components, ordered, quantiles
from copresence.operators.batches import whole_keys
from copresence.operators.components import METRES_PER_DEGREE
from copresence.operators.stays import EARTH_METRES, HOUR, crowded_devices, runs, slotted
from copresence.session import cut, stored

_DEVICE = "device_aid"


def class_steps(points: DataFrame, t_max: list[int], r1: float) -> DataFrame:
    """One row per point and class of settings: `mask` (bit i for t_max[i]), `first` (number of the open group's first point) and
    `stretch` (number of the stretch's first point). A task streams over sorted pieces; its state is three numbers a class."""
    least = min(t_max)

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, classes, before = None, [], None
        for frame in frames:
            place, out = [], []
            names = zip(frame[_DEVICE].tolist(), frame["piece"].tolist())
            for row, (own, seq, ts, lat, lng) in enumerate(zip(names, *(frame[c].tolist() for c in ("seq", "timestamp", "latitude", "longitude")))):
                if own != key:
                    key, classes, gap = own, [], 0
                    opened = (1 << len(t_max)) - 1
                else:
                    gap, opened = ts - before[0], 0
                reset = sum(1 << i for i, t in enumerate(t_max) if gap >= t and gap - t + 1 > t)
                filled = sum(1 << i for i, t in enumerate(t_max) if gap >= t) & ~reset
                now = []
                for mask, first, stretch, n, y, x in classes:
                    opened |= mask & reset
                    for part, extra in ((mask & ~reset & ~filled, 0), (mask & filled, 1)):
                        if not part:
                            continue
                        m, sy, sx = n + extra, y + extra * before[1], x + extra * before[2]
                        if _metres(sx / m, sy / m, lng, lat) > r1:
                            opened |= part
                        else:
                            now.append((part, first, seq if gap >= least or part != mask else stretch, m + 1, sy + lat, sx + lng))
                if opened:
                    now.append((opened, seq, seq, 1, lat, lng))
                classes, before = now, (ts, lat, lng)
                for c in classes:
                    place.append(row)
                    out.append(c[:3])
            if out:
                yield frame.iloc[place].reset_index(drop=True).assign(**dict(zip(("mask", "first", "stretch"), map(list, zip(*out)))))

    fields = [T.StructField("mask", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("stretch", T.LongType())]
    sorted_points = points.repartition(_DEVICE, "piece").sortWithinPartitions(_DEVICE, "piece", "seq")
    return sorted_points.mapInPandas(label, T.StructType([*points.schema.fields, *fields]))


def _metres(lng_a: float, lat_a: float, lng_b: float, lat_b: float) -> float:
    a, b = math.radians(lat_a), math.radians(lat_b)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng_b - lng_a) / 2) ** 2
    return 2 * EARTH_METRES * math.asin(min(1.0, math.sqrt(h)))


def _metres_of(lng_a: np.ndarray, lat_a: np.ndarray, lng_b: np.ndarray, lat_b: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat_a), np.radians(lat_b)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lng_b - lng_a) / 2) ** 2
    return 2 * EARTH_METRES * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _stretches(ts: np.ndarray, lat: np.ndarray, lng: np.ndarray, t_max: np.ndarray, r1: float) -> np.ndarray:
    """`class_steps` for one device: rows of mask, first point of the group, first and last point of the stretch, in order of their starts."""
    gap, bits = np.append(0, np.diff(ts))[:, None], 1 << np.arange(len(t_max))
    reset = ((gap > 2 * t_max - 1) * bits).sum(axis=1)
    filled = ((gap >= t_max) * bits).sum(axis=1) & ~reset
    moved = _metres_of(lng[:-1], lat[:-1], lng[1:], lat[1:]) > 2 * r1
    fresh = np.append(True, moved | (gap[1:, 0] > 2 * t_max.max() - 1))
    apart, every = gap[:, 0] >= t_max.min(), int(bits.sum())
    classes, found, y0, x0 = [], {}, 0.0, 0.0
    for seq, (new, gone, fills, cut_here, y, x) in enumerate(zip(*(c.tolist() for c in (fresh, reset, filled, apart, lat, lng)))):
        opened, now = every if new else 0, []
        for mask, first, stretch, n, sy, sx in () if new else classes:
            opened |= mask & gone
            for part, extra in ((mask & ~gone & ~fills, 0), (mask & fills, 1)):
                if not part:
                    continue
                m, ty, tx = n + extra, sy + extra * y0, sx + extra * x0
                if _metres(tx / m, ty / m, x, y) > r1:
                    opened |= part
                else:
                    now.append((part, first, seq if cut_here or part != mask else stretch, m + 1, ty + y, tx + x))
        if opened:
            now.append((opened, seq, seq, 1, y, x))
        classes, y0, x0 = now, y, x
        for c in now:
            found[c[:3]] = seq
    return np.array([(*k, last) for k, last in found.items()], np.int64)


def _middle(v: np.ndarray) -> float:
    v, k = np.sort(v), (len(v) - 1) // 2
    return v[k] if len(v) % 2 else v[k] + 0.5 * (v[k + 1] - v[k])


def _linked(setting: np.ndarray, lat: np.ndarray, lng: np.ndarray, metres: float) -> np.ndarray:
    """`components.link_within` for one device's groups, in order of setting and first point: their number in the setting."""
    step = 0.7 * metres / METRES_PER_DEGREE
    _, at, site = np.unique(lat + 1j * lng, return_index=True, return_inverse=True)
    ys, xs = lat[at], lng[at]
    cy = np.floor(ys / step).astype(np.int64)
    column = [np.floor(xs / (step / np.cos(np.radians((cy + up + 0.5) * step)))).astype(np.int64).tolist() for up in (0, 1, 2)]
    cells: dict[tuple[int, int], list[int]] = {}
    rows = cy.tolist()
    for i, c in enumerate(zip(rows, column[0])):
        cells.setdefault(c, []).append(i)
    number = {c: k for k, c in enumerate(cells)}
    pairs = []
    for i, (row, col) in enumerate(zip(rows, column[0])):
        for up in (0, 1, 2):
            for c in range(column[up][i] - 2, column[up][i] + 3):
                if (up or c > col) and (row + up, c) in cells:
                    pairs += [(i, j) for j in cells[row + up, c] if _metres(xs[i], ys[i], xs[j], ys[j]) <= metres]
    of_site = np.array([number[c] for c in zip(rows, column[0])], np.int64)
    key = setting * len(cells) + of_site[site]
    if pairs:  # cells that are linked under a setting take the number of one of them
        root = {k: k for k in key.tolist()}

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        present = set((setting * len(ys) + site).tolist())
        for s in np.unique(setting).tolist():
            for i, j in pairs:
                if s * len(ys) + i in present and s * len(ys) + j in present:
                    root[top(s * len(cells) + int(of_site[i]))] = top(s * len(cells) + int(of_site[j]))
        key = np.array([top(k) for k in key.tolist()], np.int64)
    _, at, place = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(at)  # places in order of setting and first group
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    before = np.searchsorted(setting[at[order]], setting)  # places of earlier settings
    return rank[place] - before + 1


def device_stays(ts: np.ndarray, lat: np.ndarray, lng: np.ndarray, t_max: np.ndarray, r1: float, r2: float, min_stay: int, min_size: int) -> list[np.ndarray]:
    """All steps of the sweep for the pings of one device, in order: t_max, loc, start, end and size of its stays."""
    keep = np.append(ts[1:] != ts[:-1], True)  # of pings with one time the last stays, as in `densify`
    ts, lat, lng = ts[keep], lat[keep], lng[keep]
    silence = np.append(np.diff(ts), -1)
    mask, first, a, b = _stretches(ts, lat, lng, t_max, r1).T
    setting, s = np.nonzero((mask >> np.arange(len(t_max))[:, None]) & 1)  # by setting, then by start
    t, first, a, b = t_max[setting], first[s], a[s], b[s]
    fill = silence[b] >= t
    more = np.where(fill, t - 1, 0)
    n, t0, t1, rest = b - a + 1 + fill, ts[a], ts[b] + more, silence[b] - more
    new = np.append(True, (setting[1:] != setting[:-1]) | (first[1:] != first[:-1]))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(s))
    good = (np.add.reduceat(n, starts) >= min_size) & (np.maximum.reduceat(t1, starts) - t0[starts] >= min_stay)
    starts, ends = starts[good], ends[good]
    if not len(starts):
        return [np.zeros(0, np.int64)] * 5
    y, x, known = lat[first[starts]], lng[first[starts]], {}
    for g in np.flatnonzero(b[ends - 1] > first[starts]).tolist():  # the others have copies of one point only
        u, v = starts[g], ends[g]
        copies = b[u:v][fill[u:v]]
        name = (first[u], b[v - 1], copies.tobytes())
        if name not in known:  # once for each distinct group
            known[name] = [_middle(np.append(c[first[u]:b[v - 1] + 1], c[copies])) for c in (lat, lng)]
        y[g], x[g] = known[name]
    loc = _linked(setting[starts], y, x, r2)
    held = np.repeat(good, np.diff(np.append(np.flatnonzero(new), len(s))))
    loc = np.repeat(loc, ends - starts)
    setting, t, a, b, n, t0, t1, rest = (c[held] for c in (setting, t, a, b, n, t0, t1, rest))
    turn = (setting[1:] != setting[:-1]) | (loc[1:] != loc[:-1]) | (a[1:] != b[:-1] + 1) | (rest[:-1] >= t[:-1])
    at = np.flatnonzero(np.append(True, turn))
    return [t[at], loc[at], t0[at], np.maximum.reduceat(t1, at), np.add.reduceat(n, at)]


def _sweep_devices(pings: DataFrame, order: list[str], t_max: list[int], *limits: float) -> DataFrame:
    """The sweep of devices that one task can hold: a device's pings are dealt once, and its stays come out of the same task."""
    settings = np.array(t_max, np.int64)
    rows = pings.select(_DEVICE, F.col("timestamp").cast("long").alias("_t"), *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    dealt = rows.repartition(_DEVICE).sortWithinPartitions(_DEVICE, *[f"_o{i}" for i in range(len(order))]).select(_DEVICE, "_t", "latitude", "longitude")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_keys(batches, 1):
            ts, lat, lng = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            found = [device_stays(ts[u:v], lat[u:v], lng[u:v], settings, *limits) for u, v in zip(starts, np.append(starts[1:], batch.num_rows))]
            device = batch.column(0).take(pa.array(np.repeat(starts, [len(f[0]) for f in found])))
            t, loc, *others = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([device, pa.array(t), pa.array(loc.astype(np.int32)), *map(pa.array, others)], names=[_DEVICE, "t_max", "loc", "start", "end", "size"])

    fields = [T.StructField(c, T.IntegerType() if c == "loc" else T.LongType()) for c in ("t_max", "loc", "start", "end", "size")]
    return dealt.mapInArrow(run, T.StructType([rows.schema[_DEVICE], *fields]))


def sweep(pings: DataFrame, order: list[str], t_max: list[int], r1: float = 30, r2: float = 30, min_stay: int = 900, min_size: int = 2) -> DataFrame:
    """Stays under every setting: device_aid, t_max (seconds), loc, start, end, size. Equal, setting by setting, to filling
    silences with `densify`, `detect_stops` and `stays_from_points`; pings must be clean."""
    crowded, limits = crowded_devices(pings), (r1, r2, min_stay, min_size)
    if crowded is None:
        return _sweep_devices(pings, order, t_max, *limits)
    few, many = (pings.join(F.broadcast(crowded), _DEVICE, how) for how in ("left_anti", "left_semi"))
    return _sweep_devices(few, order, t_max, *limits).unionByName(_sweep_crowded(many, order, t_max, *limits, crowded))


def _sweep_crowded(pings: DataFrame, order: list[str], t_max: list[int], r1: float, r2: float, min_stay: int, min_size: int, crowded: DataFrame) -> DataFrame:
    """The sweep of devices with more pings than one task may hold."""
    ahead, slot = slotted(pings.select(_DEVICE, *order, "latitude", "longitude"), crowded)
    ahead = ordered.following(ahead, [_DEVICE], slot, order, ["timestamp"])
    # of pings with one time the last stays, as in `densify`
    ahead = ahead.withColumn("silence", F.col("next_timestamp") - F.col("timestamp")).drop("next_timestamp").where("silence is null or silence > 0")
    ahead = ordered.number(ahead, [_DEVICE], slot, order, "seq").drop("slot")
    moved = haversine(F.col("prev_longitude"), F.col("prev_latitude"), F.col("longitude"), F.col("latitude")) * 1000
    gap = F.col("timestamp") - F.col("prev_timestamp")
    # beyond twice the largest setting the fill is too far from the next ping for every setting
    breaks = (moved > 2 * r1) | (gap > 2 * max(t_max) - 1)
    pieces = runs(ahead, order, breaks, ["latitude", "longitude", "timestamp"], "piece", crowded)
    points = cut(class_steps(pieces.select(_DEVICE, "piece", "seq", "timestamp", "latitude", "longitude", "silence"), t_max, r1))

    own = [_DEVICE, "mask", "first", "stretch"]
    end = F.max_by(F.struct("silence", "latitude", "longitude"), "seq").alias("end")
    stretches = points.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.max("seq").alias("last"), end)
    each = F.explode(F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(t).cast("long")) for i, t in enumerate(t_max)])))
    fill = F.coalesce(F.col("end.silence") >= F.col("t_max"), F.lit(False))
    swept = stretches.withColumn("t_max", each).withColumn("fill", fill).withColumns({
        "n": F.col("n") + F.col("fill").cast("long"), "t1": F.col("t1") + F.when(F.col("fill"), F.col("t_max") - 1).otherwise(0),
        "rest": F.col("end.silence") - F.when(F.col("fill"), F.col("t_max") - 1).otherwise(0)})
    swept = cut(swept.withColumns({"latitude": F.col("end.latitude"), "longitude": F.col("end.longitude")}).drop("end"))

    group = [_DEVICE, "t_max", "first"]
    fills = F.sum(F.when(F.col("fill"), F.xxhash64("last").cast("decimal(38,0)"))).alias("fills")
    groups = swept.groupBy(*group).agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("last").alias("last"), fills)
    stops = cut(groups.where((F.col("n") >= min_size) & (F.col("t1") - F.col("t0") >= min_stay)).withColumn("gid", F.xxhash64("first", "last", "fills")))
    # medians once for each distinct group, from the smallest setting that has it
    shown = stops.groupBy(_DEVICE, "gid").agg(F.min("t_max").alias("t_max"), F.first("first").alias("first"))
    # a stored table keeps the size its plan was guessed at, without the settings it was spread over: none of these may be broadcast
    parts = swept.join(shown.hint("merge"), group).select(*own, "gid", "fill", "latitude", "longitude")
    inside = points.select(*own, "latitude", "longitude").join(parts.select(*own, "gid").hint("merge"), own).select(_DEVICE, "gid", "latitude", "longitude")
    inside = inside.unionByName(parts.where("fill").select(_DEVICE, "gid", "latitude", "longitude"))
    centres = quantiles.medians(inside, [_DEVICE, "gid"], ["latitude", "longitude"], stops.groupBy(_DEVICE, "gid").agg(F.max("n").alias("size")))
    nodes = stops.hint("merge").join(centres, [_DEVICE, "gid"]).select(*group, F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    labels = cut(components.link_within(cut(nodes.withColumnRenamed("first", "node")), [_DEVICE, "t_max"], "node", "lat", "lng", r2))

    labelled = swept.hint("merge").join(labels.withColumnRenamed("node", "first"), group).withColumn("slot", F.floor(F.col("t0") / HOUR))
    chained = ordered.previous(labelled, [_DEVICE, "t_max"], "slot", ["t0", "stretch"], ["loc", "last", "rest"])
    new = (F.col("loc") != F.col("prev_loc")) | (F.col("stretch") != F.col("prev_last") + 1) | (F.col("prev_rest") >= F.col("t_max"))
    stay = ordered.running_sum(chained, [_DEVICE, "t_max"], "slot", ["t0", "stretch"], F.coalesce(new, F.lit(True)).cast("long"), "stay")
    return stay.groupBy(_DEVICE, "t_max", "stay").agg(
        F.min("loc").alias("loc"), F.min("t0").alias("start"), F.max("t1").alias("end"), F.sum("n").alias("size")).drop("stay")


def sweep_stats(stays: DataFrame) -> DataFrame:
    """Per setting the range, median and share of t_max or longer of the stays' minutes (`dur_`), and the same of their points per
    hour, with the share at 1 or more (`sfre_`)."""
    minutes = (F.col("end") - F.col("start")) / 60
    rate = F.when(F.col("end") > F.col("start"), F.col("size") / (minutes / 60)).otherwise(float("inf"))
    timed = stored(stays.select((F.col("t_max") / HOUR).cast("int").alias("hours"), minutes.alias("dur"), rate.alias("sfre")))

    def summary(c: str, share: Column, name: str) -> list[Column]:
        return [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(share.cast("int")).alias(name)]

    base = timed.groupBy("hours").agg(F.count(F.lit(1)).alias("stays"), *summary("dur", F.col("dur") >= F.col("hours") * 60, "dur_thre"), *summary("sfre", F.col("sfre") >= 1, "sfre_one"))
    middle = quantiles.medians_by_pieces(timed, ["hours"], ["dur", "sfre"]).withColumnsRenamed({"dur": "dur_med", "sfre": "sfre_med"})
    return base.join(middle, "hours")
