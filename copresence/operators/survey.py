"""Travel survey: trips to activities, participant filter and flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copresence.operators import ordered
from copresence.session import cut


def parse_clock(date: Column, hhmm: Column) -> Column:
    """Timestamp from a date and clock text such as '735' or '0735'."""
    text = F.concat_ws(" ", date.cast("string"), F.lpad(hhmm.cast("string"), 4, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz")


def travel_minutes(trips: DataFrame, start: str, end: str) -> DataFrame:
    """Arrivals before the departure belong to the next day; adds the travel time in minutes."""
    late = F.when(F.col(end) < F.col(start), F.timestamp_add("DAY", F.lit(1), F.col(end))).otherwise(F.col(end))
    fixed = trips.withColumn(end, late)
    return fixed.withColumn("travel_time", F.timestamp_diff("SECOND", F.col(start), F.col(end)) / 60)


def chain_features(trips: DataFrame, order: list[str]) -> DataFrame:
    """What the first and last trip of a person say about the day's chain."""
    placed = F.struct(*order, "purpose", *[c for c in ("origin", "desti") if c not in order])
    # one pass: the first and last row of a trip lead to those of the person
    legs = trips.groupBy("sub_id", "trip_id").agg(F.count(F.lit(1)).alias("legs"), F.min(placed).alias("a"), F.max(placed).alias("b"))
    ends = legs.groupBy("sub_id").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max_by("legs", "trip_id").alias("last_legs"))
    flag = lambda c: c.cast("int")
    return ends.select(
        "sub_id", flag(F.col("a.origin") == F.col("b.desti")).alias("same_zone"), flag(F.col("b.purpose") == 2).alias("comm_end"),
        flag(F.col("last_legs") > 1).alias("round_end"), flag(F.col("a.purpose") == F.col("b.purpose")).alias("same_pur"))


def selected_participants(features: DataFrame) -> DataFrame:
    """Days that start and end in one zone and close by commuting, a round trip or the first purpose."""
    return features.where((F.col("same_zone") == 1) & (F.col("comm_end") + F.col("round_end") + F.col("same_pur") > 0))


def trips_to_activities(trips: DataFrame, slot: str, order: list[str]) -> DataFrame:
    """Activities between trips: home from the day's start to the first departure, then one after each trip.

    The last one is at home until the day's end; a day that ends after midnight is the date of the last arrival.
    People with an activity of no positive length drop out. `dep` and `arr` are timestamps, `date` the survey date.
    """
    cols = ["dep", "arr", "purpose", "origin", "desti", "date"]
    chained = ordered.following(trips.select("sub_id", *cols, *dict.fromkeys(c for c in [slot, *order] if c not in cols)),
                                ["sub_id"], slot, order, ["dep"])
    first_row, last_row = F.min_by(F.struct("date", "dep"), F.struct(*order)), F.max_by("arr", F.struct(*order))
    ends = trips.groupBy("sub_id").agg(F.min(F.struct(*order)).alias("_o"), first_row.alias("a"), F.to_date(last_row).alias("_d"))
    same = F.col("a.date") == F.col("_d")
    ends = ends.select(
        "sub_id", "_o", F.when(same, F.col("a.date")).otherwise(F.date_sub("_d", 1)).cast("timestamp_ntz").alias("t0"),
        F.when(same, F.date_add("_d", 1)).otherwise(F.col("_d")).cast("timestamp_ntz").alias("t1"))
    act = lambda a, b, p, z: F.struct(a.alias("act_start"), b.alias("act_end"), p.alias("purpose"), z.alias("zone"))
    after = act(F.col("arr"), F.coalesce("next_dep", "t1"), F.when(F.col("next_dep").isNull(), 0).otherwise(F.col("purpose")), F.col("desti"))
    before = act(F.col("t0"), F.col("dep"), F.lit(0), F.col("origin"))
    rows = chained.join(ends, "sub_id")
    acts = rows.select("sub_id", F.inline(F.when(F.struct(*order) == F.col("_o"), F.array(before, after)).otherwise(F.array(after))))
    acts = cut(acts.withColumn("dur", F.timestamp_diff("SECOND", F.col("act_start"), F.col("act_end")) / 60))  # read twice below
    bad = acts.where(F.col("dur") <= 0).select("sub_id").distinct()
    label = F.when(F.col("purpose") == 0, "Home").when(F.col("purpose") == 2, "Work").when(F.col("purpose") == 3, "School").otherwise("Other")
    minute = lambda c: F.hour(c) * 60 + F.minute(c)
    return acts.join(bad, "sub_id", "left_anti").withColumns(
        {"activity": label, "h_s": minute("act_start"), "h_e": minute("act_end")})


def od_matrix(trips: DataFrame, o: Column, d: Column, w: str, once: list[str] | None = None) -> DataFrame:
    """Weighted flows between zones; `once` counts a subject's repeated flow only once."""
    flows = trips.withColumns({"o": o, "d": d})
    if once:
        flows = flows.groupBy(*once, "o", "d").agg(F.max(w).alias(w))
    return flows.groupBy("o", "d").agg(F.sum(w).alias("weight"))
