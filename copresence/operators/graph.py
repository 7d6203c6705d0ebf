"""Person-place links to place-place graphs, walks over them and their counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from copresence.functions import draws, indices
from copresence.session import cut, stored

WALKS_PER_TASK = 20_000


def shared_pairs(links: DataFrame, cols: list[str], person: str = "uid", place: str = "zone", block: int = 256) -> DataFrame:
    """Pairs of places (u < v) with a common visitor, with both links' columns (`_u`, `_v`).

    The pairs are the edges of the projected graph. A visitor with very many places is cut into blocks of places,
    and every pair of blocks is its own join key, so no task builds all pairs of a heavy visitor.
    """
    size = links.groupBy(person).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / block)).cast("int")
    cells = links.join(size, person).withColumn("_k", parts).withColumn(
        "_b", F.pmod(F.xxhash64(place), F.col("_k")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_k") - 1)
    left = cells.withColumn("_o", F.explode(others)).select(
        person, F.col(place).alias("u"), F.col("_b").alias("_bu"), F.col("_o").alias("_bv"), *[F.col(c).alias(f"{c}_u") for c in cols])
    right = cells.withColumn("_o", F.explode(others)).select(
        person, F.col(place).alias("v"), F.col("_o").alias("_bu"), F.col("_b").alias("_bv"), *[F.col(c).alias(f"{c}_v") for c in cols])
    return left.join(right, [person, "_bu", "_bv"]).where(F.col("u") < F.col("v")).drop("_bu", "_bv")


def project(links: DataFrame) -> DataFrame:
    """Unweighted projection: places with at least one common visitor, and how many there are."""
    return shared_pairs(links, []).groupBy("u", "v").agg(F.count(F.lit(1)).alias("visitors"))


def project_sum(links: DataFrame, w: str = "weight") -> DataFrame:
    """Edge weight = sum of both links over the common visitors."""
    return shared_pairs(links, [w]).groupBy("u", "v").agg(F.sum(F.col(f"{w}_u") + F.col(f"{w}_v")).alias("weight"))


def project_ice(links: DataFrame, share_a: Column | float, share_b: Column | float, w: str = "weight") -> DataFrame:
    """Edge weight = 2 + adjusted index of the common visitors, each counted with both link strengths; 0 when empty."""
    both = F.col(f"{w}_u") + F.col(f"{w}_v")
    sums = shared_pairs(links, [w, "birth_se", "birth_other", "pop"]).groupBy("u", "v").agg(
        *[F.sum(F.col(f"{c}_u") * both).alias(c) for c in ("birth_se", "birth_other", "pop")])
    index = indices.ice(F.col("birth_se"), F.col("birth_other"), F.col("pop"), share_a, share_b)
    return sums.select("u", "v", F.coalesce(index + 2, F.lit(0.0)).alias("weight"))


def prune_index(edges: DataFrame, w: str = "weight") -> tuple[DataFrame, DataFrame]:
    """Edges without zero weights, and the nodes that remain with dense ids from 0."""
    kept = edges.where(F.col(w) > 0)
    nodes = kept.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return kept, dense_ids(nodes, "node", "node_id")


def dense_ids(df: DataFrame, col: str, name: str) -> DataFrame:
    """0-based ids in the order of the values, of any type: ranges of values are counted first, so no task sees all values."""
    tagged = cut(df.repartitionByRange(col).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(col)) - 1
    return tagged.withColumn("_i", inside).join(shift, "_p").select(*df.columns, (F.col("_i") + F.col("_s")).cast("long").alias(name))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("u", "v", "weight")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges and mean degree in one row."""
    d = degrees(edges).agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("mean_degree"))
    return d


def step_index(out_edges: DataFrame) -> DataFrame:
    """Edges laid out for drawing: each node's weight range is cut into as many equal shelves as it has edges, and an
    edge is listed on every shelf it touches. A draw then meets about two edges, however large the node is."""
    cum = _laid_out(out_edges)
    shelf = F.col("total") / F.col("degree")
    top = F.col("degree") - 1
    on = lambda x: F.least(F.greatest(F.floor(x / shelf), F.lit(0)), top)
    return cum.withColumn("shelf", F.explode(F.sequence(on(F.col("lo")), on(F.col("hi")))))


def walks(edges: DataFrame, n: int = 10, length: int = 20, p: float = 1.0, q: float = 1.0, seed: int = 0, tries: int = 8) -> DataFrame:
    """Biased second-order random walks from every node: (start, walk, step, node).

    All walkers advance together. A step proposes a neighbour in proportion to edge weight through `step_index`, and
    takes it with probability bias / largest bias; walkers whose proposals all fail propose again. The result is an
    exact draw, and a step costs a few rows per walker whatever the degree. With p = q = 1 every proposal is taken.
    """
    out_edges = cut(both_ways(edges).groupBy("u", "v").agg(F.sum("weight").alias("weight")))
    index = cut(step_index(out_edges))
    totals = cut(index.groupBy("u").agg(F.max("total").alias("total"), F.max("degree").alias("degree")))
    node = out_edges.schema["u"].dataType
    plain = p == 1.0 and q == 1.0
    now = totals.select(F.col("u").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("walk")).select(
        "start", "walk", F.lit(0).alias("step"), F.col("start").alias("node"), F.lit(None).cast(node).alias("last"))
    steps = [now]
    for i in range(1, length):
        moved, waiting, tried = None, now.select("start", "walk", "last", F.col("node").alias("u")), 0
        while True:
            got = cut(_proposals(waiting, index, totals, out_edges, plain, p, q, 1 if plain else tries, tried, seed * 1009 + i))
            moved = got if moved is None else moved.unionByName(got)
            if plain:
                break
            tried += tries
            waiting = cut(waiting.join(got, ["start", "walk"], "left_anti"))
            if not waiting.take(1):
                break
        now = moved.withColumn("step", F.lit(i))
        steps.append(now)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.drop("last")


def _laid_out(out_edges: DataFrame) -> DataFrame:
    """Every edge with its weight range [lo, hi) inside its node, neighbours in order, hubs cut into pieces."""
    pieces = out_edges.withColumn("_p", F.pmod(F.xxhash64("v"), F.lit(64)))
    per_node = Window.partitionBy("u")
    below = per_node.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("u", "_p").agg(F.sum("weight").alias("_s"), F.count(F.lit(1)).alias("_n")).select(
        "u", "_p", F.coalesce(F.sum("_s").over(below), F.lit(0.0)).alias("_below"),
        F.sum("_s").over(per_node).alias("total"), F.sum("_n").over(per_node).alias("degree"))
    near = F.sum("weight").over(Window.partitionBy("u", "_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    out = pieces.withColumn("_near", near).join(sums, ["u", "_p"])
    hi = F.col("_below") + F.col("_near")
    return out.select("u", "v", "total", "degree", (hi - F.col("weight")).alias("lo"), hi.alias("hi"))


def _proposals(waiting: DataFrame, index: DataFrame, totals: DataFrame, out_edges: DataFrame, plain: bool, p: float, q: float,
               tries: int, first: int, seed: int) -> DataFrame:
    """The first accepted proposal of each waiting walker, if it has one."""
    keys = [F.col("start"), F.col("walk"), F.col("try")]
    drawn = waiting.withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1)))).join(totals, "u").withColumn(
        "t", draws.uniform(keys, seed) * F.col("total")).withColumn(
        "shelf", F.least(F.floor(F.col("t") / (F.col("total") / F.col("degree"))), F.col("degree") - 1))
    met = drawn.join(index.select("u", "v", "lo", "hi", "shelf"), ["u", "shelf"])
    # rounding may leave a sliver between two ranges or make them overlap: the nearest range on the shelf is taken
    gap = F.greatest(F.col("lo") - F.col("t"), F.col("t") - F.col("hi"), F.lit(0.0))
    one = met.groupBy("start", "walk", "try").agg(F.min_by(F.struct("v", "u", "last"), F.struct(gap, "lo")).alias("m")).select("start", "walk", "try", "m.*")
    if not plain:
        near = out_edges.select(F.col("u").alias("last"), "v", F.lit(True).alias("_near"))
        one = one.join(near, ["last", "v"], "left")
        bias = F.when(F.col("v") == F.col("last"), 1.0 / p).when(F.col("_near"), 1.0).otherwise(1.0 / q)
        accept = F.col("last").isNull() | (draws.uniform(keys, seed + 7919) * max(1.0, 1.0 / p, 1.0 / q) <= bias)
        one = one.where(accept).groupBy("start", "walk").agg(F.min_by(F.struct("v", "u"), "try").alias("m")).select("start", "walk", "m.*")
    return one.select("start", "walk", F.col("v").alias("node"), F.col("u").alias("last"))


def pair_counts(walked: DataFrame, window: int = 5) -> DataFrame:
    """How often two nodes stand within `window` steps of each other on a walk (skip-gram pairs)."""
    shift = F.explode(F.sequence(F.lit(1), F.lit(window)))
    ahead = walked.select("start", "walk", "step", F.col("node").alias("target")).withColumn("_g", shift).withColumn("step", F.col("step") + F.col("_g"))
    pairs = ahead.join(walked.select("start", "walk", "step", F.col("node").alias("context")), ["start", "walk", "step"])
    return pairs.groupBy("target", "context").agg(F.count(F.lit(1)).alias("n"))


def skip_gram_examples(walked: DataFrame, ids: DataFrame, window: int, negatives: float, pick: Callable[[list[Column]], Column],
                       key: tuple[str, ...] = ("start", "walk")) -> DataFrame:
    """Training pairs of node ids: target, context (the smaller id first, equal ones left out), label (1 met, 0 drawn) and weight.

    Every two places of a walk within `window` steps are two couples, one from each side. A walk of P couples gets floor(P * negatives)
    drawn pairs: its targets, shuffled by a seeded number, are gone through again and again, each time with a context drawn
    evenly from all ids. `ids` has node and node_id, from 1 without gaps. Draws name the walk and a place in it, so partitioning changes nothing.
    """
    on = list(key)
    keys, ids = [F.col(c) for c in on], stored(ids.select("node", "node_id"))  # the size of the ids is known: few ones come to the walks
    lone = walked.join(ids, "node").groupBy(*on).agg(F.collect_list(F.struct("step", "node_id")).alias("_w"))  # a walk has a fixed, short length

    def couples(a: Column) -> Column:
        near = F.filter("_w", lambda b: (b["step"] != a["step"]) & (F.abs(b["step"] - a["step"]) <= window))
        return F.transform(near, lambda b: F.struct(pick([*keys, a["step"], b["step"]]).alias("u"), a["step"].alias("i"), b["step"].alias("j"),
                                                    a["node_id"].alias("target"), b["node_id"].alias("context")))

    shuffled = lone.select(*on, F.sort_array(F.flatten(F.transform("_w", couples))).alias("_c"))
    each = shuffled.select(*on, F.size("_c").alias("_p"), F.posexplode("_c").alias("_r", "_c")).withColumn("_n", ids.select(F.count(F.lit(1))).scalar())
    wanted = F.floor(F.col("_p") * negatives).cast("long")
    copies = F.floor(wanted / F.col("_p")) + (F.col("_r") < wanted % F.col("_p")).cast("long")
    drawn = F.transform(F.filter(F.sequence(F.lit(0), copies), lambda k: k < copies), lambda k: F.struct(
        draws.position(pick([*keys, F.col("_r"), k]), F.col("_n")).alias("context"), F.lit(0).alias("label")))
    met = F.array(F.struct(F.col("_c.context").alias("context"), F.lit(1).alias("label")))
    both = each.select(F.col("_c.target").alias("target"), F.explode(F.concat(met, drawn)).alias("_e")).select("target", "_e.*")
    return both.where("target <> context").groupBy(F.least("target", "context").alias("target"), F.greatest("target", "context").alias("context"), "label").agg(
        F.count(F.lit(1)).alias("weight"))


def embed(walked: DataFrame, dim: int = 64, window: int = 5, seed: int = 0) -> DataFrame:
    """Node vectors from the walks as sentences; a walk has a fixed, short length."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    sentences = walked.groupBy("start", "walk").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("step", F.col("node").cast("string").alias("node")))), lambda s: s["node"]).alias("nodes"))
    sentences = cut(sentences)
    parts = 1 + sentences.count() // WALKS_PER_TASK
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=0, seed=seed, numPartitions=parts, inputCol="nodes", outputCol="v").fit(sentences)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("embedding"))
