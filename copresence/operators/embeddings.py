"""Axes, class means and projections of embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def class_means(emb: DataFrame, cls: str, vec: str = "embedding", default: str | None = None, within: list[str] | None = None) -> DataFrame:
    """Mean vector per class as an array; rows without a class may fall into a default one."""
    c = F.col(cls) if default is None else F.coalesce(F.col(cls), F.lit(default))
    keys = [*(within or []), "class"]
    flat = emb.withColumn("class", c).where(F.col("class").isNotNull()).select(*keys, F.posexplode(vec).alias("pos", "v"))
    means = flat.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    entries = F.array_sort(F.collect_list(F.struct("pos", "m")))  # one entry per dimension
    return means.groupBy(*keys).agg(F.transform(entries, lambda e: e["m"]).alias("mean"))


def axis(emb: DataFrame, cls: str, hi: str, lo: str, vec: str = "embedding", within: list[str] | None = None) -> DataFrame:
    """Mean vector of class hi minus that of class lo; with `within`, per stratum and then averaged over strata."""
    means = class_means(emb.where(F.col(cls).isin(hi, lo)), cls, vec, within=within)
    side = lambda n: F.max(F.when(F.col("class") == n, F.col("mean")))
    both = means.groupBy(*(within or [])).agg(side(hi).alias("a"), side(lo).alias("b"))
    diff = both.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.zip_with("a", "b", lambda x, y: x - y).alias("axis"))
    if not within:
        return diff
    flat = diff.select(F.posexplode("axis").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"))
    return flat.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("axis"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def project_on(emb: DataFrame, axes: dict[str, DataFrame], vec: str = "embedding") -> DataFrame:
    """Cosine of every vector with each axis; an axis is one vector and enters as a scalar subquery."""
    return emb.withColumns({f"_{n}": a.scalar() for n, a in axes.items()}).withColumns(
        {n: cosine(F.col(vec), F.col(f"_{n}")) for n in axes}).drop(vec, *[f"_{n}" for n in axes])


def project_on_classes(emb: DataFrame, means: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Cosine of every vector with every class mean; classes are few and travel as one array."""
    table = means.agg(F.sort_array(F.collect_list(F.struct("class", "mean")))).scalar()
    rows = emb.select(key, vec).withColumn("_t", table).withColumn("_c", F.explode("_t"))
    return rows.select(key, F.col("_c.class").alias("class"), cosine(F.col(vec), F.col("_c.mean")).alias("cosine"))
