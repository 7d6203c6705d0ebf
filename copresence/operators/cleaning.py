"""Filters, de-duplication and labels that prepare the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from copresence.operators import quantiles


def valid_coords(df: DataFrame, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """Keep points inside the bounds of the projection."""
    return df.where(F.col(lat).between(-80, 84) & F.col(lng).between(-180, 180))


def drop_points(df: DataFrame, points: DataFrame, on: list[str]) -> DataFrame:
    """Drop rows at listed coordinates."""
    return df.join(points.select(*on).distinct(), on, "left_anti")


def kept_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, rows after and the share kept in percent, in one result row."""
    n0 = before.agg(F.count(F.lit(1)).alias("rows_before"))
    n1 = after.agg(F.count(F.lit(1)).alias("n")).scalar()
    return n0.withColumn("rows_after", n1).withColumn("kept", F.col("rows_after") / F.col("rows_before") * 100)


def quality_filter(stops: DataFrame, stats: DataFrame, home: DataFrame | None = None, min_days: int = 7,
                   min_locs: int = 2, max_dur: float = 720) -> DataFrame:
    """Short enough stays of people seen on enough days at enough places, with a home if one is asked for."""
    good = stats.where((F.col("num_days") > min_days) & (F.col("num_loc") > min_locs)).select("uid")
    out = stops.where(F.col("dur") < max_dur).join(good, "uid", "left_semi")
    return out if home is None else out.join(home.select("uid"), "uid", "left_semi")


def drop_inf(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinite and NaN values become null, then rows with a null go."""
    ok = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.withColumns({c: F.when(ok(F.col(c)), F.col(c)) for c in cols}).dropna(subset=cols)


def first_per(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """One row per key, the first in the given order; an aggregate, so a hot key is combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def complete_subjects(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Subjects that have no missing value in any row."""
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.join(df.where(gap).select(key).distinct(), key, "left_anti")


def having_size(df: DataFrame, key: str, lo: int, hi: int) -> DataFrame:
    """Rows of keys with between lo and hi rows."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(lo, hi))
    return df.join(keys.select(key), key, "left_semi")


def to_shares(df: DataFrame, cols: list[str], total: str) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c).cast("double"), F.col(total)) for c in cols})


def one_hot(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.withColumns({f"{col}_{v}": (F.col(col) == v).cast("int") for v in values})


def ladder(x: Column, edges: list[Column], names: list[str] | None = None, include_lowest: bool = True) -> Column:
    """Bin number (or label) for edges known only at run time; bins (a, b], the first closed."""
    out = F.lit(None)
    for i in reversed(range(len(edges) - 1)):
        above = (x >= edges[i]) if include_lowest and i == 0 else (x > edges[i])
        out = F.when(above & (x <= edges[i + 1]), F.lit(names[i] if names else i + 1)).otherwise(out)
    return out


def qcut(df: DataFrame, col: str, probs: list[float], name: str, labels: list[str] | None = None) -> DataFrame:
    """Bins on quantiles of the data itself."""
    q = quantiles.quantiles(df, [], col, probs)
    edges = q.agg(F.sort_array(F.collect_list(F.struct("prob", "value"))).alias("e")).select(
        F.transform("e", lambda s: s["value"])).scalar()  # one number per probability
    with_edges = df.withColumn("_e", edges)
    picks = [F.element_at("_e", i + 1) for i in range(len(probs))]
    return with_edges.withColumn(name, ladder(F.col(col).cast("double"), picks, labels)).drop("_e")


def wqcut(df: DataFrame, col: str, w: str, probs: list[float], by: list[str], name: str,
          labels: list[str] | None = None) -> DataFrame:
    """Bins on weighted quantiles inside each group; outer edges are open."""
    q = quantiles.wide(quantiles.wquantile_ecdf(df, by, col, w, probs), by, {p: f"_q{i}" for i, p in enumerate(probs)})
    inf = F.lit(float("inf"))
    edges = [-inf, *[F.col(f"_q{i}") for i in range(len(probs))], inf]
    return df.join(q, by).withColumn(name, ladder(F.col(col).cast("double"), edges, labels)).drop(
        *[f"_q{i}" for i in range(len(probs))])


def map_values(df: DataFrame, col: str, table: dict[str, str], name: str, default: str | None = None) -> DataFrame:
    """Category map from a fixed table."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    found = F.try_element_at(F.create_map(*pairs), F.col(col))
    return df.withColumn(name, found if default is None else F.coalesce(found, F.lit(default)))


def fallback(simulated: Column, original: Column) -> Column:
    """The simulated place, or the original one where none was drawn."""
    return F.coalesce(F.nullif(simulated, F.lit("")), original)


def recode_zone(df: DataFrame, col: str) -> DataFrame:
    """County, municipality and urban class from the positions of a region code."""
    code = F.col(col)
    kind = F.substring(code, 5, 1)
    return df.withColumns({
        "county": F.substring(code, 1, 2), "municipality": F.substring(code, 1, 4),
        "urban": F.when(kind == "C", "Urban").when(kind == "B", "Suburban").when(kind == "A", "Rural/Suburban")})


def extremes(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The k lowest and k highest rows of a group, each side picked by its own top-k."""
    up = Window.partitionBy(*by).orderBy(*order)
    down = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    low = df.withColumn("side", F.lit("low")).withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= k)
    high = df.withColumn("side", F.lit("high")).withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= k)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # a row that is on both sides of a small group counts once, as low
    high = high.join(n, by).where(F.col("_r") <= F.col("_n") - k).drop("_n")
    return low.unionByName(high).drop("_r")
