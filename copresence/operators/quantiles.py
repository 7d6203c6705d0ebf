"""Weighted and plain quantiles by group, exact, without sorting a whole group in one task.

Step 1 sums the weights per (group, piece of the value range); step 2 finds the piece that holds each wanted
quantile from those sums; step 3 looks only at the rows of that piece. The group a task sorts is one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from copresence.operators.ordered import crowded, piece_of, sizes, split_points
from copresence.session import stored


#: Rows of a group whose values may stand in one array.
FEW = 10_000


def _group(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _weighted(df: DataFrame, by: list[str], x: str, w: str, *more: str) -> DataFrame:
    named = {"_x": x, "_w": w, **dict(zip(("_wmin", "_wmax"), more))}
    return (
        df.select(*by, *[F.col(c).cast("double").alias(n) for n, c in named.items()])
        .where(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.col("_w") > 0))
    )


def _located(pieces: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Running weight around each piece and the wanted weight of each probability."""
    ordered = _group(by).orderBy("_piece")
    return (
        pieces.withColumn("_hi", F.sum("_s").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_lo", F.coalesce(F.sum("_s").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_all", F.max("_hi").over(_group(by)))
        .withColumn("_px", F.lag("_last").over(ordered)).withColumn("_nx", F.lead("_first").over(ordered))
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_t", F.col("prob") * F.col("_all"))
    )


def wquantile_ecdf(df: DataFrame, by: list[str], x: str, w: str, probs: list[float], cuts: list[float] | None = None, again: bool = False):
    """Smallest value whose cumulative weight reaches p*W; on equality the mean of it and the next value.

    With `again` rows are read twice: once for the sums of pieces, which combine before the shuffle, then for the values of the pieces
    that hold a quantile; without it all values are summed once.
    """
    cuts = split_points(df, x) if cuts is None else cuts
    keys = [*by, "_piece"]
    rows = _weighted(df, by, x, w).withColumn("_piece", piece_of(F.col("_x"), cuts))
    summed = lambda r: r.groupBy(*keys, "_x").agg(F.sum("_w").alias("_s1"))
    parts, weight = (rows, "_w") if again else (summed(rows), "_s1")
    pieces = _located(parts.groupBy(*keys).agg(F.sum(weight).alias("_s"), F.min("_x").alias("_first"), F.max("_x").alias("_last")), by, probs)
    starts = (F.col("_lo") < F.col("_t")) | F.col("_px").isNull()
    targets = pieces.where(starts & (F.col("_t") <= F.col("_hi"))).select(*keys, "prob", "_t", "_lo", "_nx")
    if again:
        targets = stored(targets)
        values = summed(rows.join(targets.select(*keys).distinct(), keys, "left_semi"))
    else:
        values = parts
    win = Window.partitionBy(*keys, "prob").orderBy("_x")
    hit = (
        values.join(targets, keys)
        .withColumn("_at", F.col("_lo") + F.sum("_s1").over(win.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_later", F.lead("_x").over(win))
        # the last value of the piece always counts: its running sum may miss the piece total by rounding
        .where((F.col("_at") >= F.col("_t")) | F.col("_later").isNull())
    )
    after = F.coalesce("_later", "_nx")
    value = F.when((F.col("_at") == F.col("_t")) & after.isNotNull(), (F.col("_x") + after) / 2).otherwise(F.col("_x"))
    return hit.withColumn("_v", value).groupBy(*by, "prob").agg(F.min_by("_v", "_x").alias("value"))


def wquantile_interp(df: DataFrame, by: list[str], x: str, w: str, probs: list[float], cuts: list[float] | None = None,
                     w_min: str | None = None, w_max: str | None = None):
    """Linear interpolation over knots (cumulative weight minus half the own weight)/W, clamped at the ends.

    Rows with equal values are ordered by weight, so only the first and last row of a value set knots. A row may
    itself stand for several rows of one value: `w` is then their sum, `w_min` and `w_max` their extremes.
    """
    cuts = split_points(df, x) if cuts is None else cuts
    keys = [*by, "_piece"]
    rows = _weighted(df, by, x, w, w_min or w, w_max or w).withColumn("_piece", piece_of(F.col("_x"), cuts))
    values = rows.groupBy(*keys, "_x").agg(F.sum("_w").alias("_s1"), F.min("_wmin").alias("_wf"), F.max("_wmax").alias("_wl"))
    pieces = _located(values.groupBy(*keys).agg(
        F.sum("_s1").alias("_s"), F.min("_x").alias("_first"), F.max("_x").alias("_last"),
        F.min_by("_wf", "_x").alias("_w0"), F.max_by("_wl", "_x").alias("_w1")), by, probs)
    before = F.lag("_w1").over(Window.partitionBy(*by, "prob").orderBy("_piece"))
    pieces = pieces.withColumns({"_kf": F.col("_lo") + F.col("_w0") / 2, "_kl": F.col("_hi") - F.col("_w1") / 2, "_kp": F.col("_lo") - before / 2})
    t = F.col("_t")
    below = (t < F.col("_kf")) & (F.col("_px").isNull() | (t > F.col("_kp")))
    above = (t > F.col("_kl")) & F.col("_nx").isNull()
    inside = (F.col("_kf") <= t) & (t <= F.col("_kl"))
    step = (t - F.col("_kp")) / (F.col("_kf") - F.col("_kp"))
    # between two pieces, or outside all knots, the edges of the pieces are enough
    direct = F.when(above, F.col("_last")).when(below & F.col("_px").isNull(), F.col("_first")).when(
        below, F.col("_px") + step * (F.col("_first") - F.col("_px")))
    look = F.when(direct.isNull(), F.col("_piece"))  # null keys find nothing
    wanted = pieces.where(below | above | inside).select(*by, look.alias("_look"), "prob", "_t", "_lo", direct.alias("_direct"))
    win = Window.partitionBy(*by, "_look", "prob").orderBy("_x")
    knots = (
        wanted.join(values.withColumnRenamed("_piece", "_look"), [*by, "_look"], "left")
        .withColumn("_at", F.col("_lo") + F.sum("_s1").over(win.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_f", F.col("_at") - F.col("_s1") + F.col("_wf") / 2).withColumn("_l", F.col("_at") - F.col("_wl") / 2)
        .withColumn("_xb", F.lead("_x").over(win)).withColumn("_fb", F.lead("_f").over(win)).withColumn("_xa", F.lag("_x").over(win))
        # the first value of the piece always counts: its knot may miss the piece's by rounding
        .where(F.col("_direct").isNotNull() | ((F.col("_f") <= t) | F.col("_xa").isNull()) & (F.col("_xb").isNull() | (t < F.col("_fb"))))
    )
    part = (t - F.col("_l")) / (F.col("_fb") - F.col("_l"))
    value = F.when(F.col("_direct").isNotNull(), F.col("_direct")).when((t <= F.col("_l")) | F.col("_xb").isNull(), F.col("_x")).otherwise(
        F.col("_x") + part * (F.col("_xb") - F.col("_x")))
    rank = F.coalesce("_x", F.lit(0.0))  # a direct result is a single row without a value row
    return knots.select(*by, "prob", value.alias("_v"), rank.alias("_x")).groupBy(*by, "prob").agg(F.min_by("_v", "_x").alias("value"))


def wmedian_of_sums(df: DataFrame, by: list[str], x: str, cuts: list[float]) -> DataFrame:
    """Interpolated weighted median of rows that carry w (sum), w_min and w_max of the rows behind them."""
    out = wquantile_interp(df, by, x, "w", [0.5], cuts, "w_min", "w_max")
    return out.select(*by, "value")


def quantiles(df: DataFrame, by: list[str], x: str, probs: list[float], cuts: list[float] | None = None, n: str | None = None):
    """Plain quantiles with linear interpolation between order statistics (position p*(n-1)).

    With `n`, a row stands for that many equal values.
    """
    cuts = split_points(df, x) if cuts is None else cuts
    copies = F.lit(1) if n is None else F.col(n)
    counted = (
        df.select(*by, F.col(x).cast("double").alias("_x"), copies.cast("long").alias("_c"))
        .where(F.col("_x").isNotNull() & ~F.isnan("_x"))
        .groupBy(*by, "_x").agg(F.sum("_c").alias("_n")).withColumn("_piece", piece_of(F.col("_x"), cuts))
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = group.orderBy("_piece")
    pieces = (
        counted.groupBy(*by, "_piece").agg(F.sum("_n").alias("_s"), F.min("_x").alias("_min"))
        .withColumn("_hi", F.sum("_s").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_lo", F.col("_hi") - F.col("_s"))
        .withColumn("_next", F.lead("_min").over(ordered))
        .withColumn("_all", F.sum("_s").over(group))
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_pos", F.col("prob") * (F.col("_all") - 1))
        .withColumn("_k", F.floor("_pos"))
        .where((F.col("_lo") <= F.col("_k")) & (F.col("_k") < F.col("_hi")))
    )
    win = Window.partitionBy(*by, "_piece", "prob").orderBy("_x")
    hit = (
        counted.join(pieces.select(*by, "_piece", "prob", "_lo", "_pos", "_k", "_next"), [*by, "_piece"])
        .withColumn("_at", F.col("_lo") + F.sum("_n").over(win.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_after", F.coalesce(F.lead("_x").over(win), F.col("_next")))
        .where((F.col("_at") > F.col("_k")) & (F.col("_at") - F.col("_n") <= F.col("_k")))
    )
    upper = F.when(F.col("_at") > F.col("_k") + 1, F.col("_x")).otherwise(F.coalesce("_after", "_x"))
    return hit.select(*by, "prob", (F.col("_x") + (F.col("_pos") - F.col("_k")) * (upper - F.col("_x"))).alias("value"))


def wide(long: DataFrame, by: list[str], names: dict[float, str]) -> DataFrame:
    """One column per probability."""
    picks = [F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for p, n in names.items()]
    return long.groupBy(*by).agg(*picks)


def median(df: DataFrame, by: list[str], x: str, name: str, cuts: list[float] | None = None) -> DataFrame:
    return quantiles(df, by, x, [0.5], cuts).select(*by, F.col("value").alias(name))


def medians(df: DataFrame, by: list[str], cols: list[str], counted: DataFrame | None = None) -> DataFrame:
    """Plain medians of several columns in one pass.

    A group of few rows is sorted as an array, the others by pieces of the value range. `counted` has the rows of each group
    as `size`, where that is known already.
    """
    many = crowded(sizes(df, by) if counted is None else counted, by, FEW)
    few = _array_medians(df if many is None else df.join(many, by, "left_anti"), by, cols)
    return few if many is None else few.unionByName(medians_by_pieces(df.join(many, by, "left_semi"), by, cols))


def _array_medians(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    valid = lambda x: F.when(~F.isnan(x), x)
    lists = df.groupBy(*by).agg(*[F.sort_array(F.collect_list(valid(F.col(c).cast("double")))).alias(c) for c in cols])

    def middle(v: Column) -> Column:
        at = 0.5 * (F.size(v) - 1)
        x = F.get(v, F.floor(at).cast("int"))
        return x + (at - F.floor(at)) * (F.coalesce(F.get(v, F.floor(at).cast("int") + 1), x) - x)

    return lists.where(sum(F.size(c) for c in cols) > 0).select(*by, *[middle(F.col(c)).alias(c) for c in cols])


def medians_by_pieces(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Plain medians of several columns, for groups of any length."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val")) for c in cols]))
    long = df.select(*by, stacked.alias("_s")).select(*by, "_s.*")
    q = quantiles(long, [*by, "_col"], "_val", [0.5], split_points(long, "_val", 32 * len(cols)))
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("_col") == c, F.col("value"))).alias(c) for c in cols])


def group_stats(df: DataFrame, by: list[str], x: str, w: str, cuts: list[float] | None = None, again: bool = False) -> DataFrame:
    """Weighted quartiles and mean by group; `again` as in `wquantile_ecdf`."""
    q = wide(wquantile_ecdf(df, by, x, w, [0.25, 0.5, 0.75], cuts, again), by, {0.25: "q25", 0.5: "q50", 0.75: "q75"})
    m = df.groupBy(*by).agg((F.sum(F.col(x) * F.col(w)) / F.sum(F.when(F.col(x).isNotNull(), F.col(w)))).alias("avg"))
    return q.join(m, by) if by else q.withColumn("avg", m.scalar())
