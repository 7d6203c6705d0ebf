"""Segregation of places per half hour, person-place links and group mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copresence.functions import indices
from copresence.operators import ordered, quantiles
from copresence.session import cut

TIME = ["weekday", "holiday"]


def presence(bins: DataFrame, unit: str, extra: list[str] | None = None) -> DataFrame:
    """Rows of one person in one place and half hour, summed before anything is joined to them."""
    keys = [*TIME, unit, "time_seq", *(extra or []), "uid"]
    return bins.where(F.col(unit).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("wt_total").alias("w"), F.min("wt_total").alias("w_min"),
        F.max("wt_total").alias("w_max"))


def zone_indices(bins: DataFrame, persons: DataFrame, unit: str, share_a=None, share_b=None,
                 extra: list[str] | None = None) -> DataFrame:
    """Visit counts, evenness of income and concentration at the extremes for each place and half hour.

    Only sums are needed, so a crowded cell is combined before the shuffle and never sits in one task.
    """
    return _sums(presence(bins, unit, extra).join(persons, "uid"), [*TIME, unit, "time_seq", *(extra or [])], share_a, share_b)


def _sums(people: DataFrame, cell: list[str], share_a, share_b) -> DataFrame:
    w = F.col("w")
    total = {c: F.sum(F.col(c) * w) for c in ("q1", "q2", "q3", "q4", "birth_se", "birth_other", "pop")}
    sums = people.groupBy(*cell).agg(
        F.sum("n").alias("num_visits"), F.sum("w").alias("num_visits_wt"), F.count(F.lit(1)).alias("num_unique_uid"),
        *[s.alias(c) for c, s in total.items()])
    even = indices.evenness([F.col(q) for q in ("q1", "q2", "q3", "q4")])
    ice = indices.ice(F.col("birth_se"), F.col("birth_other"), F.col("pop"), share_a, share_b)
    return sums.select(*cell, "num_visits", "num_visits_wt", "num_unique_uid", even.alias("evenness_income"), ice.alias("ice_birth"))


def place_metrics(bins: DataFrame, persons: DataFrame, unit: str, attrs: list[str], share_a=None, share_b=None) -> DataFrame:
    """`zone_indices` plus the interpolated weighted median of each visitor attribute."""
    cell = [*TIME, unit, "time_seq"]
    people = cut(presence(bins, unit).join(persons, "uid"))  # read by the sums and by the medians
    base = _sums(people, cell, share_a, share_b)
    # attributes belong to persons: one value per person, so visits only contribute weights
    stacked = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("double").alias("v")) for a in attrs]))
    long = people.select(*cell, "w", "w_min", "w_max", stacked.alias("s")).select(*cell, "s.attr", "s.v", "w", "w_min", "w_max")
    cuts = ordered.split_points(persons.select(F.explode(F.array(*[F.col(a).cast("double") for a in attrs])).alias("v")), "v", 16)
    mids = quantiles.wmedian_of_sums(long, [*cell, "attr"], "v", cuts)
    pivoted = mids.groupBy(*cell).agg(*[F.max(F.when(F.col("attr") == a, F.col("value"))).alias(a) for a in attrs])
    return base.join(pivoted, cell, "left")


def links(bins: DataFrame, unit: str, time: list[str] | None = None) -> DataFrame:
    """Link strength of person and place: half hours times weight, static or per half hour and replicate."""
    return bins.groupBy("uid", unit, *(time or [])).agg(F.sum("wt_total").alias("weight"))


def links_from_spans(visits: DataFrame, unit: str) -> DataFrame:
    """Static link strength from the span lengths, without exploding bins."""
    from copresence.functions.time_bins import span_length
    return visits.groupBy("uid", unit).agg(F.sum(span_length(F.col("time_span")) * F.col("wt_total")).alias("weight"))


def place_mix(people: DataFrame, cell: list[str], group: str = "grp_r", w: str = "wt_p") -> DataFrame:
    """Weight of each residential group present in a cell."""
    part = lambda g: F.sum(F.when(F.col(group) == g, F.col(w)).otherwise(0.0))
    return people.groupBy(*cell).agg(part("F").alias("f"), part("D").alias("d"), part("N").alias("n"))


def busy_places(metrics: DataFrame, unit: str, least: int = 5) -> DataFrame:
    """Places whose visits add up to more than `least`."""
    return metrics.groupBy(unit).agg(F.sum("num_visits").alias("visits")).where(F.col("visits") > least)


def unit_ice(metrics: DataFrame, unit: str, least: int = 5, w: str = "num_visits_wt") -> DataFrame:
    """Visit-weighted mean index of a place over the cells with enough people."""
    kept = metrics.where(F.col("num_unique_uid") >= least)
    return kept.groupBy(unit).agg((F.sum(F.col("ice_birth") * F.col(w)) / F.sum(w)).alias("ice_birth"),
                                  (F.sum(F.col("evenness_income") * F.col(w)) / F.sum(w)).alias("evenness_income"))


def unit_id(zone, cell):
    """Zone code where the zone is kept whole (cell '0'), else the cell."""
    return F.when(cell == "0", zone).otherwise(cell)
