"""Comparisons between groups: moments, ranks, tests, effect sizes and summary tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from copresence.functions import labels
from copresence.functions.draws import poisson, poisson_one, uniform
from copresence.functions.tails import t_tail
from copresence.operators import bootstrap, cleaning, ordered, quantiles, series
from copresence.operators.mobility import share_within
from copresence.session import beside


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of groups side by side."""
    return a.join(b, by) if by else a.withColumns({c: b.select(c).scalar() for c in b.columns})


def wavg(x: Column, w: Column) -> Column:
    """Weighted mean over the rows that have a value."""
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def wmoments(df: DataFrame, by: list[str], x: str, w: str, ddof: int = 1) -> DataFrame:
    """Weighted mean and standard deviation; squares are taken around the mean, in a second pass."""
    first = df.groupBy(*by).agg(wavg(F.col(x), F.col(w)).alias("_m"), F.sum(w).alias("_sum"))
    out = beside(df, first, by).groupBy(*by).agg(
        F.first("_sum").alias("weight"), F.first("_m").alias("mean"), F.sum(F.col(w) * F.pow(F.col(x) - F.col("_m"), 2)).alias("_ss"))
    return out.select(*by, "weight", "mean", F.sqrt(F.col("_ss") / (F.col("weight") - ddof)).alias("std"))


def wcorr(df: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted Pearson correlation."""
    m = df.groupBy(*by).agg(wavg(F.col(x), F.col(w)).alias("_mx"), wavg(F.col(y), F.col(w)).alias("_my"))
    c = beside(df, m, by)
    dx, dy, wt = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"), F.col(w)
    return c.groupBy(*by).agg((F.sum(wt * dx * dy) / F.sqrt(F.sum(wt * dx * dx) * F.sum(wt * dy * dy))).alias("r"))


def replicates(df: DataFrame, keys: list[str], n: int, seed: int, rate: Column | None = None) -> DataFrame:
    """Bootstrap rows: each row gets a seeded Poisson count per replicate and rows with count 0 vanish.

    Counts depend on the row key, the replicate and the seed only, so they do not change with partitioning.
    """
    sim = df.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = uniform([F.col(k) for k in keys] + [F.col("sim")], seed)
    return sim.withColumn("copies", poisson_one(u) if rate is None else poisson(rate, u)).where("copies > 0")


def wcorr_se(df: DataFrame, by: list[str], x: str, y: str, w: str, n: int = 1000, **draws) -> DataFrame:
    """Weighted correlation with its bootstrap standard error."""
    return _beside(wcorr(df, by, x, y, w), bootstrap.correlation_error(df, by, x, y, w, n, **draws), by)


def boot_median(df: DataFrame, by: list[str], x: str, w: str, n: int = 1000, **draws) -> DataFrame:
    """Median and standard deviation of the weighted medians of resampled rows."""
    return bootstrap.median(df, by, x, w, n, **draws)


def spearman(df: DataFrame, by: list[str], x: str, y: str, gate: float | None = None) -> DataFrame:
    """Rank correlation with its t statistic and two-sided p; null where a side does not vary. With a gate only rows with p below it stay."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    # ranks from their mean; x needs only sums over the rows of a value, so rows are joined for y alone, in place where y has few values
    rank = F.col("n_lt") + (F.col("n") - F.col("n_all")) / 2
    other = ordered.cumulate(both, by, y, {"n": F.count(F.lit(1))}).select(*by, y, rank.alias("_ry"))
    ranked = beside(both, other, [*by, y])
    cum = ordered.cumulate(ranked, by, x, {"n": F.count(F.lit(1)), "_s": F.sum("_ry"), "_q": F.sum(F.col("_ry") * F.col("_ry"))}, ordered.split_points(both, x))
    out = cum.withColumn("_rx", rank).groupBy(*by).agg(
        F.try_divide(F.sum(F.col("_rx") * F.col("_s")), F.sqrt(F.sum(F.col("_rx") * F.col("_rx") * F.col("n"))) * F.sqrt(F.sum("_q"))).alias("rho"), F.sum("n").alias("n"))
    left = 1 - F.col("rho") * F.col("rho")
    perfect = (F.col("n") > 2) & (left < 1e-15)
    t = F.when(perfect, F.signum("rho") * float("inf")).otherwise(F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, left)))
    out = out.withColumn("t", t).withColumn("p", 2 * t_tail(F.abs("t"), F.col("n") - 2))
    return out if gate is None else out.where(F.col("p") < gate)


def signed_rank(df: DataFrame, by: list[str], x: str, copies: str, cuts: list[float] | None = None) -> DataFrame:
    """Signed-rank sums of counted values, zeros left out, with the tie-corrected normal score."""
    v = df.where(F.col(x) != 0).withColumn("_a", F.abs(x))
    n_pos = F.sum(F.when(F.col(x) > 0, F.col(copies)).otherwise(0))
    cum = ordered.cumulate(v, by, "_a", {"n": F.sum(copies), "pos": n_pos}, cuts)
    rank = F.col("n_lt") + (F.col("n") + 1) / 2
    n = F.col("_n").cast("double")
    out = cum.groupBy(*by).agg(
        F.sum(rank * F.col("pos")).alias("t_plus"), F.max("n_all").alias("_n"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("_ties"))
    mean = n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    return out.select(*by, "t_plus", F.col("_n").alias("n"), ((F.col("t_plus") - mean) / sd).alias("z"))


def boot_wilcoxon(df: DataFrame, by: list[str], x: str, w: str, baseline: float, side: str, n: int = 1000, **draws) -> DataFrame:
    """Signed-rank test of x - baseline on resamples drawn in proportion to weight; mean and sd over replicates."""
    return bootstrap.wilcoxon(df, by, x, w, baseline, side, n, **draws)


def segregated(df: DataFrame, by: list[str], x: str, w: str, band: float = 0.2, level: float = 0.001, n: int = 1000, **draws) -> DataFrame:
    """1 where a group's index lies outside the band by either one-sided test, else 0."""
    up = boot_wilcoxon(df, by, x, w, band, "greater", n, **draws).select(*by, F.col("p_mean").alias("p_greater"))
    low = boot_wilcoxon(df, by, x, w, -band, "less", n, **draws).select(*by, F.col("p_mean").alias("p_less"))
    inside = (F.col("p_greater") > level) & (F.col("p_less") > level)
    return _beside(up, low, by).withColumn("seg", F.when(inside, 0).otherwise(1))


def wrank_test(df: DataFrame, by: list[str], x: str, g: str, w: str) -> DataFrame:
    """Weighted two-sample rank test with a design-based variance; g is 0 or 1.

    Ranks are weighted mid-ranks over both samples, compared by the weighted difference of means.
    """
    cum = ordered.cumulate(df, by, x, {"w": F.sum(w)})
    score = cum.select(*by, x, ((F.col("w_lt") + F.col("w") / 2) / F.col("w_all")).alias("_r"))
    rows = df.join(score, [*by, x])
    one, wt, r = F.col(g) == 1, F.col(w), F.col("_r")
    part = lambda c, e: F.sum(F.when(c, e).otherwise(0.0))
    m = rows.groupBy(*by).agg(part(one, wt).alias("_w1"), part(~one, wt).alias("_w0"), F.count(F.lit(1)).alias("n"),
                              (part(one, wt * r) / part(one, wt)).alias("_m1"), (part(~one, wt * r) / part(~one, wt)).alias("_m0"))
    infl = F.when(one, wt * (r - F.col("_m1")) / F.col("_w1")).otherwise(wt * (r - F.col("_m0")) / F.col("_w0"))
    var = beside(rows, m, by).groupBy(*by).agg(F.sum(infl * infl).alias("_ss"))
    out = _beside(m, var, by).withColumn("estimate", F.col("_m1") - F.col("_m0"))
    t = F.col("estimate") / F.sqrt(F.col("_ss") * F.col("n") / (F.col("n") - 1))
    return out.select(*by, "n", "estimate", t.alias("t"))


def wks(df: DataFrame, by: list[str], x: str, g: str, w: str) -> DataFrame:
    """Largest gap between the weighted distribution functions of two samples; g is 0 or 1."""
    side = lambda v: F.sum(F.when(F.col(g) == v, F.col(w)).otherwise(0.0))
    cum = ordered.cumulate(df, by, x, {"a": side(0), "b": side(1)})
    gap = F.abs((F.col("a_lt") + F.col("a")) / F.col("a_all") - (F.col("b_lt") + F.col("b")) / F.col("b_all"))
    return cum.groupBy(*by).agg(F.max(gap).alias("ks"))


def cohen_d(df: DataFrame, by: list[str], x1: str, x2: str, w: str) -> DataFrame:
    """Weighted standardised difference of two variables and its size word."""
    a = wmoments(df, by, x1, w).withColumnsRenamed({"mean": "m1", "std": "s1"})
    b = wmoments(df, by, x2, w).select(*by, F.col("mean").alias("m2"), F.col("std").alias("s2"))
    n = F.col("weight")
    pooled = F.sqrt((F.pow("s1", 2) * (n - 1) + F.pow("s2", 2) * (n - 1)) / (n + n - 2))
    out = _beside(a, b, by).withColumn("d", (F.col("m1") - F.col("m2")) / pooled)
    return out.withColumn("size", labels.effect_size(F.col("d"))).select(*by, "d", "size")


def wmean_ci(df: DataFrame, by: list[str], x: str, w: str, z: float = 1.959963984540054) -> DataFrame:
    """Weighted mean with the confidence interval of the mean; z is the normal quantile of the level."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    m = _beside(wmoments(df, by, x, w, ddof=0), n, by)
    se = F.col("std") / F.sqrt("n")
    return m.select(*by, "mean", (F.col("mean") - z * se).alias("lower"), (F.col("mean") + z * se).alias("upper"))


def ice_group(df: DataFrame, by: list[str], x: str, threshold: float = 0.2, least: int = 4, name: str = "grp") -> DataFrame:
    """Class of each key's series of half-hour values."""
    return series.classes(df, by, x, threshold, least, name)


def ssi(od: DataFrame, x: str, y: str) -> DataFrame:
    """Similarity of two flow tables, both scaled to sum 1."""
    tx, ty = od.select(F.sum(x)).scalar(), od.select(F.sum(y)).scalar()
    sx, sy = F.col(x) / F.col("_tx"), F.col(y) / F.col("_ty")
    return od.withColumns({"_tx": tx, "_ty": ty}).agg((2 * F.sum(F.least(sx, sy)) / (F.sum(sx) + F.sum(sy))).alias("ssi"))


def feature_screen(df: DataFrame, cols: list[str], y: str, most: float = 10.0, centred: bool = False) -> DataFrame:
    """Variance inflation and univariate F score per feature, kept features, and the rank by F.

    Inflation is that of the raw columns without a constant, or with `centred` that of the centred ones. One pass of moment sums; only
    they, k x k numbers, reach the driver.
    """
    names = [*cols, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(F.col(a) * F.col(b)).alias(f"m{i}") for i, (a, b) in enumerate(pairs)]]
    row = df.dropna(subset=names).agg(*sums).first()
    k = len(names)
    corr, raw = np.eye(k), np.eye(k)
    for i, (a, b) in enumerate(pairs):
        at, to = names.index(a), names.index(b)
        raw[at, to] = raw[to, at] = row[f"m{i}"]
        if at != to:
            corr[at, to] = corr[to, at] = row[f"c{i}"]
    length = np.sqrt(np.diag(raw))
    vif = np.diag(np.linalg.inv((corr if centred else raw / np.outer(length, length))[:-1, :-1]))
    f = [corr[i, -1] ** 2 / (1 - corr[i, -1] ** 2) * (row["n"] - 2) for i in range(k - 1)]
    rank = {i: r + 1 for r, i in enumerate(sorted(range(k - 1), key=lambda i: (-f[i], cols[i])))}
    data = [(cols[i], float(vif[i]), float(f[i]), bool(vif[i] < most), rank[i]) for i in range(k - 1)]
    return df.sparkSession.createDataFrame(data, "feature string, vif double, f double, keep boolean, rank int")


def ccdf(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Share of rows above each value."""
    cum = ordered.cumulate(df, by, x, {"n": F.count(F.lit(1))})
    return cum.select(*by, x, (1 - (F.col("n_lt") + F.col("n")) / F.col("n_all")).alias("ccdf"))


def describe(df: DataFrame, by: list[str], x: str) -> DataFrame:
    base = df.groupBy(*by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                               F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles.wide(quantiles.quantiles(df, by, x, [0.25, 0.5, 0.75]), by, {0.25: "q25", 0.5: "q50", 0.75: "q75"})
    return _beside(base, q, by)


def whist(df: DataFrame, by: list[str], x: str, w: str, lo: float, width: float, log: bool = False) -> DataFrame:
    """Weighted histogram with equal bins of x, or of log10 x; `bin` counts from 0 at lo."""
    v = F.log10(x) if log else F.col(x)
    ok = df.where(F.col(x) > 0) if log else df
    return ok.withColumn("bin", F.floor((v - lo) / width).cast("int")).groupBy(*by, "bin").agg(
        F.sum(w).alias("weight"), F.count(F.lit(1)).alias("n"))


def hist2d(df: DataFrame, x: str, y: str, wx: float, wy: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / wx).cast("int").alias("bin_x"), F.floor(F.col(y) / wy).cast("int").alias("bin_y")).agg(
        F.count(F.lit(1)).alias("n"))


def access_stats(df: DataFrame, access: str, var: str, w: str, by: list[str], n: int = 25) -> DataFrame:
    """Quantile groups of access, labelled by their weighted mean access, with weighted stats of var."""
    grouped = cleaning.qcut(df, access, [i / n for i in range(n + 1)], "access_grp")
    keys = [*by, "access_grp"]
    label = grouped.groupBy("access_grp").agg(wavg(F.col(access), F.col(w)).alias("access_mean"))
    return quantiles.group_stats(grouped, keys, var, w).join(label, "access_grp")


def weighted_share(df: DataFrame, by: list[str], cond: Column, w: str, name: str) -> DataFrame:
    """Weight in percent for which a condition holds."""
    return df.groupBy(*by).agg((F.sum(F.when(cond, F.col(w)).otherwise(0.0)) / F.sum(w) * 100).alias(name))


def reduction_share(df: DataFrame, by: list[str], base: str, delta: str, w: str, drop: float = -0.2) -> DataFrame:
    """People whose segregation falls by at least a fifth of its home value."""
    return weighted_share(df, by, F.try_divide(F.col(delta), F.abs(base)) <= drop, w, "share_dec")


def reduced_share(df: DataFrame, by: list[str], a: str, b: str, w: str) -> DataFrame:
    """People for whom a is smaller than b in absolute value."""
    return weighted_share(df, by, F.abs(a) < F.abs(b), w, "share_reduced")


def grid_map(df: DataFrame, keys: list[str], means: list[str], w: str) -> DataFrame:
    """Weight and weighted means per map cell and group."""
    return df.groupBy(*keys).agg(F.sum(w).alias("pop"), *[wavg(F.col(m), F.col(w)).alias(m) for m in means])


def seg_share(zones: DataFrame, area: str, ice: str, limit: float = 0.2) -> DataFrame:
    """Share of zones per area whose index lies outside the band, in percent."""
    return zones.groupBy(area).agg(F.count(F.lit(1)).alias("zones"), (F.avg((F.abs(ice) > limit).cast("int")) * 100).alias("segregated"))


def heterogeneity(df: DataFrame, by: list[str], cats: list[str], metrics: list[str], w: str) -> DataFrame:
    """Weighted quartiles and mean of every metric in every level of every category, stacked, in one plan.

    Rows are taken apart where they are read and combine to (group, piece of the value range) before the shuffle; only values of the
    pieces that hold a quartile are summed one by one.
    """
    values = F.array(*[F.struct(F.lit(m).alias("var"), F.col(m).cast("double").alias("value")) for m in metrics])
    level = F.explode(F.array(*[F.struct(F.lit(c).alias("cate_name"), F.col(c).cast("string").alias("cate_level")) for c in cats]))
    cuts = ordered.split_points(df.select(F.explode(values).alias("m")).select("m.value"), "value")
    long = df.select(*by, w, level.alias("c"), values.alias("m")).select(*by, w, "c", F.explode("m").alias("m")).select(*by, "c.*", "m.*", w)
    return quantiles.group_stats(long, [*by, "cate_name", "cate_level", "var"], "value", w, cuts, again=True)


def importance_compare(a: DataFrame, b: DataFrame, name: str, score: str, top: int = 10) -> DataFrame:
    """Features among the top of either model, with both ranks; one row per feature."""
    from pyspark.sql import Window

    def ranked(df: DataFrame, suffix: str) -> DataFrame:
        order = Window.orderBy(F.desc(score), name)  # features of a model, a short list
        return df.select(name, F.col(score).alias(f"{score}_{suffix}"), F.row_number().over(order).alias(f"rank_{suffix}"))

    both = ranked(a, "a").join(ranked(b, "b"), name, "full")
    return both.where((F.col("rank_a") <= top) | (F.col("rank_b") <= top))


def crosstab(df: DataFrame, r: str, c: str, w: str, values: list) -> DataFrame:
    """Weighted contingency table, rows scaled to sum 1, empty cells zero."""
    table = df.groupBy(r).pivot(c, values).agg(F.sum(w)).fillna(0.0)
    total = sum([F.col(str(v)) for v in values[1:]], F.col(str(values[0])))
    return table.select(r, *[F.try_divide(F.col(str(v)), total).alias(str(v)) for v in values])


def type_tempo(bins: DataFrame, kind: str, w: str) -> DataFrame:
    """Time-of-day profile of each type, scaled to sum 1, with all 48 bins."""
    from copresence.operators.profiles import fill_bins
    sums = bins.groupBy(kind, "time_seq").agg(F.sum(w).alias("_w"))
    return fill_bins(share_within(sums, [kind], "_w", "share").drop("_w"), [kind], {"share": 0.0}, first=1, name="time_seq")


def type_stats(person_types: DataFrame, kind: str, x: str, w: str, by: list[str]) -> DataFrame:
    """Median of a person per type (and replicate), then weighted quartiles per group and type."""
    person = quantiles.median(person_types, ["uid", kind, w, *by], x, x)
    return quantiles.group_stats(person, [kind, *by], x, w)
