"""Connected components of nearby points inside a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from copresence.functions.distance import haversine
from copresence.operators import ordered
from copresence.session import cut

METRES_PER_DEGREE = 111_195.0  # of latitude on a sphere of 6371 km


def link_within(points: DataFrame, by: list[str], node: str, lat: str, lng: str, metres: float, name: str = "loc"):
    """Label points of a key that are linked by steps of at most `metres`; labels count from 1 by first node.

    Cells have a diagonal just below the link length, so points of one cell belong together without comparing
    them, and cells are the nodes of the graph. Only points of neighbouring cells are compared, each pair of cells from its lower one.
    """
    step = 0.7 * metres / METRES_PER_DEGREE

    def width(row: Column) -> Column:
        return step / F.cos(F.radians((row + 0.5) * step))

    sites = cut(  # read by both sides of the join and for the cells
        points.groupBy(*by, lat, lng).agg(F.min(node).alias("first_node"))
        .withColumn("cy", F.floor(F.col(lat) / step)).withColumn("cx", F.floor(F.col(lng) / width(F.col("cy"))))
    )
    cells = sites.groupBy(*by, "cy", "cx").agg(F.min("first_node").alias("v"))
    around = lambda c, steps: F.explode(F.array(*[F.col(c) + i for i in steps]))
    left = (
        sites.withColumnsRenamed({"cy": "ay", "cx": "ax"}).withColumn("cy", around("ay", (0, 1, 2)))
        .withColumn("_c", F.floor(F.col(lng) / width(F.col("cy")))).withColumn("cx", around("_c", (-2, -1, 0, 1, 2)))
        .select(*by, "ay", "ax", "cy", "cx", F.col(lat).alias("alat"), F.col(lng).alias("alng"))
        .where((F.col("ay") != F.col("cy")) | (F.col("ax") < F.col("cx")))
    )
    near = haversine(F.col("alng"), F.col("alat"), F.col(lng), F.col(lat)) * 1000 <= metres
    # size statistics do not see that each site is listed 12 times, so the listed side asks for a merge join
    linked = left.hint("merge").join(sites, [*by, "cy", "cx"]).where(near).select(*by, "ay", "ax", "cy", "cx").distinct()
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = (
        linked.join(cells.withColumnRenamed("v", "b"), [*by, "cy", "cx"])
        .select(*by, F.col("ay").alias("cy"), F.col("ax").alias("cx"), "b")
        .join(cells.withColumnRenamed("v", "a"), [*by, "cy", "cx"]).select(*by, both.alias("e")).select(*by, "e.a", "e.b")
    )
    comp = components(cells.select(*by, "v"), edges, by)
    if ordered.crowded(ordered.sizes(sites, by), by) is None:
        ranked = comp.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy("root")).cast("int"))
    else:
        places = comp.select(*by, "root").distinct().withColumn("_slot", F.floor(F.col("root") / 10000))
        roots = ordered.number(places, by, "_slot", ["root"], name).select(*by, "root", F.col(name).cast("int").alias(name))
        ranked = comp.join(roots, [*by, "root"])
    labelled = cells.join(ranked, [*by, "v"]).select(*by, "cy", "cx", name)
    placed = points.withColumn("cy", F.floor(F.col(lat) / step)).withColumn("cx", F.floor(F.col(lng) / width(F.col("cy"))))
    return placed.join(labelled, [*by, "cy", "cx"]).select(*by, node, name)


def components(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Smallest node of each component by label spreading with pointer jumping; lineage is cut in every round."""
    edges = cut(edges)
    labels = nodes.withColumn("root", F.col("v"))
    if not edges.take(1):
        return labels
    labels = cut(labels)
    while True:  # a label falls in every round but the last
        heard = (
            edges.join(labels.withColumnRenamed("v", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("v"))
            .agg(F.min("root").alias("heard"))
        )
        new = labels.join(heard, [*by, "v"], "left").select(
            *by, "v", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = new.select(*by, F.col("v").alias("root"), F.col("root").alias("further"))
        new = cut(new.join(jump, [*by, "root"], "left").select(
            *by, "v", "old", F.coalesce("further", "root").alias("root")))
        if not new.where(F.col("old") != F.col("root")).take(1):
            return new.drop("old")
        labels = new.drop("old")
