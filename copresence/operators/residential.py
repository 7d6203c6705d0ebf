"""Residential segregation of zones and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copresence.functions import indices


def _sum(df: DataFrame, c: Column) -> Column:
    """A total over the whole table, as a scalar subquery."""
    return df.select(F.sum(c)).scalar()


def evenness_table(zones: DataFrame, key: str, quarters: list[str]) -> DataFrame:
    return zones.select(key, indices.evenness([F.col(q) for q in quarters]).alias("evenness"))


def dissimilarity_table(zones: DataFrame, key: str, a: str, b: str, pop: str) -> DataFrame:
    """Each zone's term of the index of dissimilarity; a and b are counts."""
    sa, sb = F.col(a) / F.col(pop), F.col(b) / F.col(pop)
    term = indices.dissimilarity_term(sa, sb, F.col(pop), _sum(zones, F.col(a)), _sum(zones, F.col(b)))
    return zones.select(key, term.alias("evenness"))


def isolation_table(zones: DataFrame, key: str, var: str, pop: str, total_of: str, reverse: bool = False) -> DataFrame:
    term = indices.isolation_term(F.col(var) / F.col(pop), F.col(pop), _sum(zones, F.col(total_of)), reverse)
    return zones.select(key, term.alias("iso"))


def ice_table(zones: DataFrame, key: str, a: str, b: str, pop: str, adjusted: bool = True) -> DataFrame:
    if not adjusted:
        return zones.select(key, indices.ice(F.col(a), F.col(b), F.col(pop)).alias("ice"))
    total = _sum(zones, F.col(pop))
    index = indices.ice(F.col(a), F.col(b), F.col(pop), _sum(zones, F.col(a)) / total, _sum(zones, F.col(b)) / total)
    return zones.select(key, index.alias("ice"))


def ice_region(zones: DataFrame, region: Column, a: str, b: str, pop: str) -> DataFrame:
    """Adjusted index of whole regions against the shares of all zones."""
    total = _sum(zones, F.col(pop))
    share_a, share_b = _sum(zones, F.col(a)) / total, _sum(zones, F.col(b)) / total
    sums = zones.groupBy(region.alias("region")).agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(pop).alias("pop"))
    return sums.select("region", indices.ice(F.col("a"), F.col("b"), F.col("pop"), share_a, share_b).alias("ice"))


def stack(parts: dict[str, DataFrame], label: str = "var") -> DataFrame:
    """Union of tables with a source label."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(label, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def outer_merge(parts: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of measures on their keys."""
    out = parts[0]
    for df in parts[1:]:
        out = out.join(df, on, "full")
    return out


def residential(zones: DataFrame, key: str, quarters: list[str], pop: str, native: str, foreign: str) -> DataFrame:
    """Evenness, isolation and concentration of each zone, stacked by the variable they measure."""
    even = stack({"income": evenness_table(zones, key, quarters),
                  "birth_region": dissimilarity_table(zones, key, native, foreign, pop)})
    iso = stack({"income": isolation_table(zones, key, quarters[0], pop, quarters[0]),
                 "birth_region": isolation_table(zones, key, native, pop, foreign, reverse=True)})
    ice = stack({"income": ice_table(zones, key, quarters[3], quarters[0], pop, adjusted=False),
                 "birth_region": ice_table(zones, key, native, foreign, pop)})
    return outer_merge([even, iso, ice], [key, "var"])
