"""Seeded null models of destination choice and residence.

`sim` is a column, so all replicates share one plan. A draw is a function of row key, replicate and seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from copresence.functions import draws, indices
from copresence.functions.distance import planar
from copresence.functions.labels import tag_tier
from copresence.session import cut

Picker = Callable[[list[Column]], Column]


def hashed(seed: int) -> Picker:
    """Uniform numbers from a seeded hash of the keys."""
    return lambda keys: draws.uniform(keys, seed)


def movable(stops: DataFrame) -> DataFrame:
    """Stops that may move: away from home and at a tagged place."""
    return stops.where((F.col("home") == 0) & F.col("tag").isNotNull())


def tag_classes(tag: Column) -> Column:
    """(tier, class) entries of a tag: two tags are similar at a tier when they share its entry."""
    has_kind = F.contains(tag, F.lit("("))
    entry = lambda n, v: F.struct(F.lit(n).alias("tier"), v.alias("class"))
    entries = F.array(
        entry(1, tag), F.when(has_kind, entry(2, F.split(tag, r" \(")[0])),
        F.when(tag.isin("Office", "Craft"), entry(3, F.lit("trade"))),
        F.when(F.contains(tag, F.lit("(s)")) | (tag == "Shop"), entry(4, F.lit("shop"))))
    return F.array_compact(entries)


def _spots(pois: DataFrame, cols: list[str]) -> DataFrame:
    """Places with equal coordinates and tag (and unit) are one row with a count."""
    return pois.groupBy(*cols).agg(F.count(F.lit(1)).alias("places"))


def _lowest_tier(pairs: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    """Per key the candidates of the lowest tier present, with the number of places behind each."""
    return _lowest(_counted(pairs, key, what), key)


def _counted(pairs: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    # a pair may share several classes; it counts once, at its lowest tier
    once = pairs.where(F.col("tier") == tag_tier(F.col("tag"), F.col("ptag")))
    return once.groupBy(*key, "tier", *what).agg(F.sum("places").alias("places"))


def _lowest(units: DataFrame, key: list[str]) -> DataFrame:
    low = units.groupBy(*key).agg(F.min("tier").alias("tier"))
    return units.join(low, [*key, "tier"])


def candidate_pool(origins: DataFrame, pois: DataFrame, unit: str, lo: float = 30.0, hi: float = 1000.0) -> DataFrame:
    """Units one may move to from a place: tags similar, lo < distance <= hi, lowest similarity tier present.

    Origins are distinct (x, y, tag); places are summed to (x, y, tag, unit). The join is on 1 hi-cell and shared
    tag class, so places that could never be chosen are not paired.
    """
    classes = lambda df, tag: df.withColumn("c", F.explode(tag_classes(F.col(tag)))).select("*", "c.*").drop("c")
    around = lambda c: F.explode(F.array(*[F.floor(F.col(c) / hi) + i for i in (-1, 0, 1)]))
    left = classes(origins.select("x", "y", "tag").distinct(), "tag").withColumns(
        {"bx": F.floor(F.col("x") / hi), "by": F.floor(F.col("y") / hi)})
    right = classes(_spots(pois, ["x", "y", "tag", unit]).withColumnsRenamed({"x": "px", "y": "py", "tag": "ptag"}), "ptag")
    right = right.withColumn("bx", around("px")).withColumn("by", around("py")).hint("merge")  # its size is not seen by statistics
    d = planar(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    pairs = left.join(right, ["bx", "by", "tier", "class"]).where((d > lo) & (d <= hi))
    return _lowest_tier(pairs, ["x", "y", "tag"], [unit])


def pool_index(pool: DataFrame, key: list[str], unit: str) -> DataFrame:
    """Pools laid out for drawing: (key, shelf, lo, hi, unit, pool_size, units).

    The places of a pool stand in a row, unit by unit; a unit holds the places lo+1 to hi. The row is cut into as many equal shelves as the
    pool has units, and a unit is listed on every shelf it touches, so a draw meets about two rows, however large the pool is.
    """
    per_key = Window.partitionBy(*key)
    upto = F.sum("places").over(per_key.orderBy(unit).rowsBetween(Window.unboundedPreceding, 0))
    laid = pool.select(*key, unit, "places").withColumns({
        "hi": upto, "pool_size": F.sum("places").over(per_key), "units": F.count(F.lit(1)).over(per_key)}).withColumn("lo", F.col("hi") - F.col("places"))
    return laid.withColumn("shelf", F.explode(F.sequence(_shelf(F.col("lo")), _shelf(F.col("hi") - 1)))).drop("places")


def _shelf(place: Column) -> Column:
    """The shelf of a place counted from 0."""
    return F.floor(place * F.col("units") / F.col("pool_size"))


def draw(stops: DataFrame, pool: DataFrame, key: list[str], unit: str, ids: list[str], n: int, pick: Picker) -> DataFrame:
    """n draws with replacement per stop: one row per (stop, sim) with the drawn unit; null where no pool exists."""
    sizes = pool.groupBy(*key).agg(F.sum("places").alias("pool_size"), F.count(F.lit(1)).alias("units"))
    out = stops.join(sizes, key, "left").withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n))))
    out = out.withColumn("_at", draws.position(pick([*[F.col(c) for c in ids], F.col("sim")]), F.col("pool_size")))
    out = out.withColumn("shelf", _shelf(F.col("_at") - 1)).drop("units")
    listed = pool_index(pool, key, unit).select(*key, "shelf", "lo", "hi", F.col(unit).alias(f"{unit}_s"))
    met = out.join(listed, [*key, "shelf"], "left").where(F.col("lo").isNull() | ((F.col("_at") > F.col("lo")) & (F.col("_at") <= F.col("hi"))))
    return met.drop("_at", "shelf", "lo", "hi")


def draw_counts(drawn: DataFrame, ids: list[str], unit: str) -> DataFrame:
    """Draws as counts per stop and unit."""
    return drawn.where(F.col(f"{unit}_s").isNotNull()).groupBy(*ids, f"{unit}_s").agg(F.count(F.lit(1)).alias("n"))


def shift_once(stops: DataFrame, pool: DataFrame, key: list[str], unit: str, ids: list[str], pick: Picker) -> DataFrame:
    """One replacement unit per stop with the size of its pool (0 where there is none)."""
    return draw(stops, pool, key, unit, ids, 1, pick).drop("sim").fillna({"pool_size": 0})


def shift_shares(shifted: DataFrame, unit: str) -> DataFrame:
    """Share of stops that have a replacement, and of those the share that changes unit, in percent."""
    has = F.col("pool_size") > 0
    changed = F.when(has, (F.col(f"{unit}_s") != F.col(unit)).cast("int"))
    return shifted.agg((F.avg(has.cast("int")) * 100).alias("shifted"), (F.avg(changed) * 100).alias("changed"))


def merge_moved(kept: DataFrame, drawn: DataFrame, unit: str, n: int, drop: bool = False) -> DataFrame:
    """All stops per replicate: moved ones at their drawn unit (or where they were), the rest unchanged."""
    moved = drawn.where(F.col(f"{unit}_s").isNotNull()) if drop else drawn
    moved = moved.withColumn(unit, F.coalesce(F.col(f"{unit}_s"), F.col(unit)))
    still = kept.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n))))
    cols = [c for c in kept.columns if c in moved.columns] + ["sim"]
    return moved.select(*cols).unionByName(still.select(*cols))


#: (keys, node of the tree) to a number between 0 and 1 for each key.
Uniforms = Callable[[np.ndarray, int], np.ndarray]


def seeded_nodes(seed: int) -> Uniforms:
    """Numbers hashed from key, node and seed."""
    return lambda keys, node: draws.hashed_uniform(keys, 1, seed * 1_000_003 + node)[:, 0]


def drawn_distances(persons: DataFrame, decay: DataFrame, key: Column, n: int = 1000, uniforms: Uniforms | None = None) -> DataFrame:
    """Whole distances among n draws per person from the decay curve, with how often each was drawn: `d`, `draws`.

    `key` is a whole number that names a person for the draws. The counts are split down a tree of the curve's distances. The
    curve has one row per whole kilometre, on Earth 20,038 at most, and travels with the tasks. Distances must have a share above 0.
    """
    uniforms = uniforms or seeded_nodes(1)
    curve = decay.where("fd > 0").select(F.col("d").cast("int").alias("d"), F.col("fd").cast("double").alias("fd")).orderBy("d").collect()
    at, shares = np.array([r["d"] for r in curve], np.int32), np.array([r["fd"] for r in curve])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            row, where, count = draws.multinomial_tree(n, shares, uniforms, frame["_key"].to_numpy(np.int64))
            yield frame.iloc[row].drop(columns="_key").assign(d=at[where], draws=count)

    schema = T.StructType([*persons.schema.fields, T.StructField("d", T.IntegerType()), T.StructField("draws", T.LongType())])
    if not curve:
        return persons.withColumns({"d": F.lit(None).cast("int"), "draws": F.lit(0).cast("long")}).limit(0)
    return persons.withColumn("_key", key.cast("long")).mapInPandas(split, schema)


#: What decides a pool of wanted distances: home, tag and the distances drawn.
RING = ["x", "y", "tag", "ds"]


def decay_sets(wanted: DataFrame, key: list[str]) -> DataFrame:
    """Per key its home x and y, tag and the sorted distinct wanted distances `ds`; a key has one home and one tag."""
    return wanted.groupBy(*dict.fromkeys([*key, "x", "y", "tag"])).agg(F.sort_array(F.collect_set("d")).alias("ds"))


def decay_pools(sets: DataFrame, pois: DataFrame, unit: str, step: float, cell: int = 10) -> DataFrame:
    """Units at one of the distances `ds` from a home, lowest similarity tier present: one pool per home, tag and `ds`.

    Persons with one home, tag and set of distances share a pool. A ring is one home, tag and whole distance d (in steps). For every
    ring the cells of `cell` steps that it touches are listed, row of cells by row of cells; places join on the cell and on the
    shared tag class, and the exact rounded distance decides. A place lies on one ring of a home, so a pool is the sum of its rings.
    """
    pools = sets.select(*RING).distinct()
    side = step * cell
    outer, inner = (F.col("d") + 0.5) * step, F.greatest((F.col("d") - 0.5) * step, F.lit(0.0))
    rings = pools.select("x", "y", "tag", F.explode("ds").alias("d")).distinct()
    rings = rings.withColumn("cy", F.explode(F.sequence(F.floor((F.col("y") - outer) / side), F.floor((F.col("y") + outer) / side))))
    top, low = (F.col("cy") + 1) * side - F.col("y"), F.col("cy") * side - F.col("y")
    far = F.greatest(F.abs(top), F.abs(low))
    near = F.when((low <= 0) & (top >= 0), 0.0).otherwise(F.least(F.abs(top), F.abs(low)))
    reach = F.sqrt(F.greatest(outer * outer - near * near, F.lit(0.0)))
    hole = F.sqrt(F.greatest(inner * inner - far * far, F.lit(0.0)))  # |dx| below this is inside the ring's hole
    cells = lambda a, b: F.sequence(F.floor((F.col("x") + a) / side), F.floor((F.col("x") + b) / side))
    rings = rings.withColumn("cx", F.explode(F.array_union(cells(-reach, -hole), cells(hole, reach))))
    spots = _spots(pois, ["x", "y", "tag", unit]).withColumnsRenamed({"x": "px", "y": "py", "tag": "ptag"}).withColumns(
        {"cx": F.floor(F.col("px") / side), "cy": F.floor(F.col("py") / side)})
    spots = spots.withColumn("c", F.explode(tag_classes(F.col("ptag")))).select("*", "c.tier", "c.class").drop("c")
    rings = rings.withColumn("c", F.explode(tag_classes(F.col("tag")))).select("*", "c.tier", "c.class").drop("c")
    dist = F.rint(planar(F.col("x"), F.col("y"), F.col("px"), F.col("py")) / step)
    # listed sides ask for a merge join: size statistics do not see how an explode grows
    pairs = rings.hint("merge").join(spots, ["cx", "cy", "tier", "class"]).where(dist == F.col("d"))
    units = _counted(pairs, ["x", "y", "tag", "d"], [unit])
    met = pools.withColumn("d", F.explode("ds")).join(units, ["x", "y", "tag", "d"])
    return _lowest(met.groupBy(*RING, "tier", unit).agg(F.sum("places").alias("places")), RING)


def decay_pool(wanted: DataFrame, pois: DataFrame, unit: str, key: list[str], step: float, cell: int = 10) -> DataFrame:
    """Units at one of the wanted rounded distances from home, lowest similarity tier present, for every key.

    `wanted` has key columns, home x and y, tag and whole distance d (in steps).
    """
    sets = cut(decay_sets(wanted, key))  # read for the pools and for the keys that share them
    out = sets.join(decay_pools(sets, pois, unit, step, cell), RING)
    return out.select(*key, *[c for c in ("tier", unit, "places") if c not in key])


def shuffle_home(people: DataFrame, zones: DataFrame, n: int, pick: Picker, share_a: Column, share_b: Column) -> DataFrame:
    """n random residences per person and the index of the shuffled zones; zones need a dense `zone_no` from 1.

    People carry the shares a, b and o of their home zone. A person's index is that of the zone they land in.
    """
    placed = _placed(people, zones, n, pick)
    w = F.col("wt_p")
    sums = placed.groupBy("sim", "zone_no").agg(*[F.sum(F.col(c) * w).alias(c) for c in ("a", "b", "o")])
    total = F.col("a") + F.col("b") + F.col("o")
    index = indices.ice(F.try_divide(F.col("a"), total), F.try_divide(F.col("b"), total), F.lit(1.0), share_a, share_b)
    return placed.select("uid", "wt_p", "sim", "zone_no").join(sums.select("sim", "zone_no", index.alias("ice_rs")), ["sim", "zone_no"])


def _placed(people: DataFrame, zones: DataFrame, n: int, pick: Picker) -> DataFrame:
    total = zones.select(F.count(F.lit(1))).scalar()
    sims = people.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_n", total)
    return sims.withColumn("zone_no", draws.position(pick([F.col("uid"), F.col("sim")]), F.col("_n"))).drop("_n")


def shuffle_groups(people: DataFrame, zones: DataFrame, n: int, pick: Picker) -> DataFrame:
    """Group shares of the zone a person lands in, per replicate."""
    placed = _placed(people, zones, n, pick)
    part = lambda g: F.sum(F.when(F.col("grp_r") == g, F.col("wt_p")).otherwise(0.0)) / F.sum("wt_p")
    shares = placed.groupBy("sim", "zone_no").agg(part("D").alias("Ds"), part("F").alias("Fs"), part("N").alias("Ns"))
    return placed.select("uid", "wt_p", "sim", "zone_no").join(shares, ["sim", "zone_no"])


def numbered_zones(zones: DataFrame, key: str) -> DataFrame:
    """Dense numbers from 1 for the zone list."""
    return zones.select(key).distinct().withColumn("zone_no", F.row_number().over(Window.orderBy(key)))
