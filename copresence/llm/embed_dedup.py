"""Embedding near-dedup with a forest of random-projection trees.

Only vectors with equal labels (and lengths) are compared. Equal vectors are one point. The points of a label are spread over cells
that one task can hold: a cell that is too large is split again and again along random projections, with an overlap, in several
independent ways. In each cell a forest is grown: recursive random splits with spill overlap down to small leaves, over many trees. A
point's candidates are the members of its leaves; each is verified by cosine in double precision. A split is placed where few
points lie, so that it passes by groups of near copies; a node that is mostly one such group is not split, since every split
would cut links, and is compared as a whole.

A task gives the number of links of each of its points and one component label for each, not the pairs. Pairs that share several cells
are counted in the first of them only. The component labels of all cells are united in the end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from copresence.llm.common import components, counted, saved

COSINE = 0.93
TREES = 10
LEAF = 192
#: Splits are sought on this grid of shares; the points of one step on either side of a split go both ways.
GRID = [round(0.05 * i, 2) for i in range(1, 20)]
#: Points of one cell, and independent ways of spreading a label that does not fit one.
CELL = 12_000
SPREADS = 6
SEED = 17


def _direction(dim: int, *key) -> np.ndarray:
    """A random unit vector that any task finds again."""
    d = np.random.default_rng(zlib.crc32(repr((SEED, dim, *key)).encode())).normal(size=dim)
    return d / np.linalg.norm(d)


def _close(cosine: float) -> float:
    """The width of the central 70 % of projections of points of which most are linked, times the root of the dimension; random points of
    a sphere have 2.07."""
    return 2.07 * float(np.sqrt(1 - cosine))


# ---------------------------------------------------------------- inside a cell

def leaves(points: np.ndarray, tree: tuple, cosine: float, leaf: int = LEAF) -> list[np.ndarray]:
    """Members of the leaves of one tree over unit vectors."""
    done, dim = [], points.shape[1]
    share = np.minimum(GRID, 1 - np.array(GRID))[1:-1]
    todo = [(np.arange(len(points)), 1)]
    while todo:
        rows, node = todo.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        x = points[rows] @ _direction(dim, *tree, node)
        q = np.quantile(x, GRID)
        at = 1 + int(((q[2:] - q[:-2]) * share).argmax())
        left, right = rows[x <= q[at + 1]], rows[x >= q[at - 1]]
        if (q[16] - q[2]) * np.sqrt(dim) <= _close(cosine) or max(len(left), len(right)) == len(rows):
            done.append(rows)
        else:
            todo += [(left, 2 * node), (right, 2 * node + 1)]
    return done


def compare(points: np.ndarray, weights: np.ndarray, sides: np.ndarray, places: np.ndarray, cosine: float, name: str, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """Per point the weight of its links and the first point of its component in this cell.

    sides: two blocks of a cell too large for one task (only pairs across count), or all 0. places: (point, k) cells that come before this one
    and that the point is in too, -1 where there is none; pairs that share one are counted there.
    """
    n = len(points)
    across = len(np.unique(sides)) > 1
    member: list[list[np.ndarray]] = [[] for _ in range(n)]
    if across:
        halves = [np.flatnonzero(sides == s) for s in np.unique(sides)]
        for mine, others in (halves, halves[::-1]):
            for i in mine:
                member[i] = [others]
    else:
        for tree in range(trees):
            for rows in leaves(points, (name, tree), cosine):
                for i in rows:
                    member[i].append(rows)
    found, root = np.zeros(n, np.int64), np.arange(n)
    for i in range(n):
        others = member[i][0] if len(member[i]) == 1 else np.unique(np.concatenate(member[i]))
        member[i] = []
        near = others[points[others] @ points[i] >= cosine]
        near = near[near != i]
        if places.shape[1] and len(near):
            mine = places[i][places[i] >= 0]
            near = near[~np.isin(places[near], mine).any(axis=1)]
        if len(near):
            found[i] = weights[near].sum()
            known = np.unique(root[np.append(near, i)])
            if len(known) > 1:
                root[np.isin(root, known[1:])] = known[0]
    return found, root


# ---------------------------------------------------------------- over the cluster

def _cells(points: DataFrame, cosine: float, cell: int, spreads: int) -> DataFrame:
    """(node, unit, weight, key, spread, cell, crowd): every point of each cell; crowd: the points of the cell.

    A label within `cell` points is one cell. Others are split by quantiles over all their points, level by level, once per spread.
    """
    sizes = points.groupBy("key").agg(F.count("*").alias("crowd"))
    whole = points.join(sizes, "key")
    small = whole.where(F.col("crowd") <= cell).withColumn("spread", F.lit(0)).withColumn("cell", F.lit("0"))
    columns = ["node", "unit", "weight", "key", "spread", "cell", "crowd"]
    open_ = whole.where(F.col("crowd") > cell)
    if not open_.take(1):
        return small.select(columns)
    done = small.select(columns)
    open_ = open_.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(spreads - 1)))).withColumn("cell", F.lit("1")).select(columns)
    while True:
        @F.pandas_udf("double")
        def projected(unit: pd.Series, key: pd.Series, spread: pd.Series, place: pd.Series) -> pd.Series:
            known: dict = {}
            out = np.empty(len(unit))
            for i, (u, *where) in enumerate(zip(unit, key, spread, place)):
                where = tuple(where)
                if where not in known:
                    known[where] = _direction(len(u), *where)
                out[i] = u @ known[where]
            return pd.Series(out)

        open_ = saved(open_.withColumn("x", projected("unit", "key", "spread", "cell")), "cells")
        at = ["key", "spread", "cell"]
        cuts = open_.groupBy(*at).agg(F.percentile_approx("x", GRID, 2000).alias("q"), F.max(F.size("unit")).alias("dim"))
        q = F.col("q")
        steps = F.array(*[F.struct(((q[i + 1] - q[i - 1]) * min(GRID[i], 1 - GRID[i])).alias("gain"), q[i - 1].alias("low"), q[i + 1].alias("high")) for i in range(1, len(GRID) - 1)])
        cuts = saved(cuts.select(*at, F.array_max(steps).alias("cut"), ((q[16] - q[2]) * F.sqrt("dim") > F.lit(_close(cosine))).alias("wide")), "cuts")
        open_ = open_.join(cuts, at)
        done = done.unionByName(open_.where(~F.col("wide")).select(columns))
        side = F.array_compact(F.array(
            F.when(F.col("x") <= F.col("cut.high"), F.concat("cell", F.lit("0"))), F.when(F.col("x") >= F.col("cut.low"), F.concat("cell", F.lit("1")))))
        halves = open_.where("wide").withColumn("cell", F.explode(side)).drop("crowd")
        crowds = halves.groupBy(*at).agg(F.count("*").alias("crowd"))
        halves = saved(halves.join(crowds, at).select(columns), "cells")
        done = done.unionByName(halves.where(F.col("crowd") <= cell))
        open_ = halves.where(F.col("crowd") > cell)
        if not open_.take(1):
            return done


def links(points: DataFrame, cosine: float = COSINE, cell: int = CELL, spreads: int = SPREADS, trees: int = TREES) -> DataFrame:
    """(node, links, root): per point of (node, unit, weight, key) the weight of its links and a point it is connected with, per cell."""
    place = F.shiftleft(F.col("spread").cast("long"), 56) + F.xxhash64("key", "spread", "cell").bitwiseAND(F.lit(2**56 - 1))
    cells = saved(_cells(points, cosine, cell, spreads).withColumn("place", place), "all-cells")
    places = saved(cells.groupBy("node").agg(F.collect_set("place").alias("places")), "places")
    placed = cells.join(places, "node").withColumn("places", F.filter("places", lambda p: p < F.col("place")))
    # a dense cell of any size: its points fall in blocks that one task can hold in twos
    blocks = F.ceil(F.col("crowd") / cell).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(SEED)), blocks).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", mine)
    twos = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("one"), F.greatest("block", other).alias("two")))
    placed = placed.withColumn("task", F.explode(twos)).select("*", "task.*")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        frame = frame.sort_values("node", ignore_index=True)
        points = np.stack([np.asarray(u, float) for u in frame["unit"]])
        held = np.full((len(frame), max(map(len, frame["places"]))), -1, np.int64)
        for i, places in enumerate(frame["places"]):
            held[i, :len(places)] = places
        same = first["one"] == first["two"]
        sides = np.zeros(len(frame), int) if same else frame["block"].to_numpy()
        if not same and len(np.unique(sides)) < 2:
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        found, root = compare(points, frame["weight"].to_numpy(np.int64), sides, held, cosine, f"{first['key']}/{first['spread']}/{first['cell']}", trees)
        nodes = frame["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "links": found, "root": nodes[root]})

    return placed.groupBy("key", "spread", "cell", "one", "two").applyInPandas(run, "node long, links long, root long")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unit(vectors: pd.Series) -> pd.Series:
    """Directions in double precision."""
    def unit(v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, float)
        v = v / np.abs(v).max()
        return v / np.sqrt(v @ v)

    return vectors.map(unit)


def near_groups(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
                cell: int = CELL, spreads: int = SPREADS, trees: int = TREES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of `cosine` or more when their labels are equal and not null. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id or label, link with nothing: no links, a component of their own, kept.
    Vectors of different lengths do not link. Repeated rows count as vectors of their own that link with each other and share the
    component; kept is true for each whose id names it. An empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    groups = rows.where("sound").groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    groups, seen = counted(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    points = saved(groups.select("node", "weight", F.concat_ws("/", F.size("v").cast("string"), "label").alias("key"), _unit(F.col("v")).alias("unit")), "points")
    found = saved(links(points, cosine, cell, spreads, trees), "found")
    roots = saved(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots", seen["n"])
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = groups.join(counts, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = saved(placed.join(low, "root").select("label", "v", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"), "named", seen["n"])
    linked = rows.where("sound").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
