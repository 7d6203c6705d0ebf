"""What a person is exposed to: experienced segregation and contacts between groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copresence.functions.time_bins import explode_bins
from copresence.operators import place

CELL = ["weekday", "holiday", "time_seq"]


def attach_place_metric(bins: DataFrame, metrics: DataFrame, unit: str, extra: list[str] | None = None) -> DataFrame:
    """Metrics of the visited place at the visited half hour; visits to places without one drop out."""
    return bins.join(metrics, [*CELL, unit, *(extra or [])])


def missing_share(bins: DataFrame, metrics: DataFrame, unit: str) -> DataFrame:
    """Share of visits in percent that find no place metric."""
    keys = metrics.select(*CELL, unit).withColumn("_hit", F.lit(1))
    per_cell = bins.groupBy(*CELL, unit).agg(F.count(F.lit(1)).alias("n"))
    return per_cell.join(keys, [*CELL, unit], "left").agg(
        F.sum("n").alias("visits"), (F.sum(F.when(F.col("_hit").isNull(), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("missing"))


def experienced(bins: DataFrame, metrics: DataFrame, unit: str, by: list[str] | None = None,
                on: list[str] | None = None) -> DataFrame:
    """Median index and mean co-presence a person meets per half hour; `by` adds keys such as type or replicate.

    Repeated visits to a place are counted first. A person's half hour then holds each place once, and the median
    is taken over (place value, count) pairs, so its state is bounded by the number of places.
    """
    keys = ["uid", *CELL, *(by or [])]
    counted = bins.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("n"))
    met = counted.join(metrics, [*CELL, unit, *(on or [])])
    n = F.col("n")
    return met.groupBy(*keys).agg(
        F.percentile("ice_birth", F.lit(0.5), n).alias("ice_birth"),
        F.percentile("evenness_income", F.lit(0.5), n).alias("evenness_income"),
        (F.sum(F.col("num_unique_uid") * n) / F.sum("n")).alias("num_coexistence"))


def experienced_spans(visits: DataFrame, metrics: DataFrame, unit: str, by: list[str] | None = None) -> DataFrame:
    """`experienced` for visits that still carry their half hours as a compact span, `time_span`.

    Equal visits are counted first, a place's day stands as one row of at most 48 values, and half hours are taken apart beside the sums that
    they go into: replicates cost a row per visit, not one per visit and half hour.
    """
    day = ["weekday", "holiday"]
    keys = ["uid", *day, *(by or [])]
    counted = visits.groupBy(*keys, unit, "time_span").agg(F.count(F.lit(1)).alias("n"))
    values = F.struct("ice_birth", "evenness_income", "num_unique_uid")
    days = metrics.groupBy(unit, *day).agg(F.map_from_entries(F.collect_list(F.struct("time_seq", values))).alias("values"))
    halves = explode_bins(counted.join(days, [unit, *day])).withColumn("v", F.try_element_at("values", F.col("time_seq"))).where("v is not null")
    n = F.col("n")
    return halves.select(*keys, "time_seq", "n", "v.*").groupBy("uid", *CELL, *(by or [])).agg(
        F.percentile("ice_birth", F.lit(0.5), n).alias("ice_birth"),
        F.percentile("evenness_income", F.lit(0.5), n).alias("evenness_income"),
        (F.sum(F.col("num_unique_uid") * n) / F.sum("n")).alias("num_coexistence"))


def home_or_place(bins: DataFrame, home_values: DataFrame, place_values: DataFrame, unit: str) -> DataFrame:
    """Index met in a half hour: the residential value on home stays, the place's value elsewhere."""
    out = bins.join(home_values.select("uid", F.col("ice_r")), "uid", "left").join(
        place_values.select(*CELL, unit, "ice_birth"), [*CELL, unit], "left")
    return out.withColumn("ice", F.when(F.col("home") == 1, F.col("ice_r")).otherwise(F.col("ice_birth")))


def sim_mean(df: DataFrame) -> DataFrame:
    """Average over all replicates, then over the half hours of a person."""
    per_bin = df.groupBy("uid", *CELL).agg(F.avg("ice_birth").alias("ice_birth"))
    return per_bin.groupBy("uid", "weekday", "holiday").agg(F.avg("ice_birth").alias("ice_birth"))


def person_mean(df: DataFrame) -> DataFrame:
    """A person's average day."""
    return df.groupBy("uid", "weekday", "holiday").agg(
        F.avg("ice_birth").alias("ice_e"), F.avg("evenness_income").alias("evenness_e"))


def person_contact(links: DataFrame, mix: DataFrame, cell: list[str], by_weight: bool = False,
                   keep: list[str] | None = None) -> DataFrame:
    """Sums of the group mixes a person meets, plainly or times the link strength."""
    met = links.join(mix, cell, "left")
    w = F.col("weight") if by_weight else F.lit(1.0)
    keys = ["uid", *(keep or [])]
    return met.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(g), F.lit(0.0)) * w).alias(g) for g in ("f", "d", "n")])


def without_self(contact: DataFrame, groups: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Take a person's own weight out of the mixes the person met."""
    own = contact.join(groups.select("uid", "grp_r", "wt_p"), "uid").join(n_cells, "uid")
    less = lambda c, g: (F.col(c) - F.when(F.col("grp_r") == g, F.col("wt_p") * F.col("cells")).otherwise(0.0)).alias(c)
    return own.select("uid", less("f", "F"), less("d", "D"), less("n", "N"))


def contact_shares(contact: DataFrame, keep: list[str]) -> DataFrame:
    """Contacts in percent; zero when a person meets nobody."""
    total = F.col("f") + F.col("d") + F.col("n")
    pct = lambda c: F.when(total > 0, F.col(c) / total * 100).otherwise(0.0).alias(c)
    return contact.select(*keep, pct("f"), pct("d"), pct("n"))


def typed_pairs(shares: DataFrame, base: dict[str, float]) -> DataFrame:
    """Difference from random mixing as long rows with the pair of groups and its kind.

    Kind 1 is the own group, 2 the opposite one, 3 any pair with the mixed group.
    """
    diffs = shares.select("*", *[(F.col(c) - base[c]).alias(f"{c}_diff") for c in ("f", "d", "n")])
    long = diffs.unpivot(["uid", "wt_p", "grp_r"], ["f_diff", "d_diff", "n_diff"], "variable", "value")
    other = F.upper(F.substring("variable", 1, 1))
    kind = F.when(F.col("grp_r") == other, 1).when((F.col("grp_r") != "N") & (other != "N"), 2).otherwise(3)
    return long.withColumns({"inter_type": F.concat("grp_r", other), "kind": kind}).drop("variable")


def time_shares(stops: DataFrame, groups: DataFrame) -> DataFrame:
    """Weighted time per place type inside each residential group, and D minus F of the shares."""
    from copresence.operators.mobility import share_within
    timed = stops.join(groups.select("uid", "grp_r", "wt_p"), "uid").groupBy("grp_r", "kind").agg(
        F.sum(F.col("dur") * F.col("wt_p")).alias("time"))
    shares = share_within(timed, ["grp_r"], "time", "share")
    table = shares.groupBy("kind").pivot("grp_r", ["D", "F", "N"]).agg(F.first("share"))
    return table.fillna(0.0).withColumn("d_minus_f", F.col("D") - F.col("F"))


def home_time(stops: DataFrame) -> DataFrame:
    """Share of a person's time spent at home."""
    at_home = F.sum(F.when(F.col("home") == 1, F.col("dur")).otherwise(0.0))
    return stops.groupBy("uid").agg((at_home / F.sum("dur")).alias("home_share"))


def group_mix_of_cells(bins: DataFrame, groups: DataFrame, cell: list[str]) -> DataFrame:
    """Group mix per cell over the distinct people present in it."""
    people = bins.select("uid", *cell).distinct().join(groups.select("uid", "grp_r", "wt_p"), "uid")
    return place.place_mix(people, cell)
