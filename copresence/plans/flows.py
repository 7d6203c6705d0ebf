"""The three chains of work over the operators; stop detection, quantile cuts and components run jobs while a chain is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copresence.functions.time_bins import explode_bins, stay_span
from copresence.operators import cleaning, experienced, home, nullmodel, place, profiles, replicates, stays
from copresence.session import cut


def stays_from_pings(pings: DataFrame, order: list[str], box: dict[str, float], home_zone: str,
                     seasons: list[tuple[str, str | None]], abnormal: DataFrame | None = None,
                     polygons: DataFrame | None = None, t_max: int = 3 * 3600) -> DataFrame:
    """Raw pings to clean stays in local time."""
    crowded = stays.crowded_devices(pings)
    points = stays.detect_stops(stays.densify(stays.clean_pings(pings), order, t_max, crowded), order, t_max=t_max, crowded=crowded)
    found = stays.stays_from_points(points).withColumnsRenamed({"device_aid": "uid", "latitude": "lat", "longitude": "lng"})
    if abnormal is not None:
        found = cleaning.drop_points(found, abnormal, ["lat", "lng"])
    timed = stays.zone_names(stays.stay_times(found), box, home_zone, polygons)
    local = stays.to_local(stays.to_local(timed, "datetime", "tzname", "localtime"), "leaving_datetime", "tzname", "leaving_localtime")
    rich = stays.add_dates(stays.enrich_time(local, seasons))
    return stays.add_seq(rich, None if crowded is None else "date", ["start", "interval"])


def homes_from_stays(found: DataFrame, zones: DataFrame, zone_of: Column, least: int = 3) -> DataFrame:
    """Stays (uid, loc, h_s, dur, holiday) to detected homes with zone and trimmed person weight.

    `zone_of` gives the zone of a home from its place columns. Places are ranked by weights of six decimals, so that the order in
    which a sum is taken decides no tie; ties go to the lowest place.
    """
    six = lambda df, c: df.withColumn(c, F.round(c, 6))
    weighted = profiles.record_weights(found, ["uid"])
    clusters = six(profiles.cluster_stats(weighted), "freq_wt")
    top = profiles.top_clusters(clusters).select("uid", "loc")
    tempo = profiles.tempo_weighted(weighted.join(top, ["uid", "loc"]), ["uid", "loc"])
    picked = home.pick_home(six(home.home_scores(tempo), "home_freq"))
    seen = clusters.where("holiday = 0").select("uid", F.col("loc").alias("home"), "freq")
    reliable = home.reliable_home(picked.join(seen, ["uid", "home"]), least).withColumn("deso", zone_of)
    return reliable.join(home.device_weights(reliable, zones).select("deso", "wt_p"), "deso")


def visits_from_stays(found: DataFrame, homes: DataFrame) -> DataFrame:
    """Stays to weighted visits that still carry their bins as a compact span."""
    spans = found.withColumn("time_span", stay_span(F.col("h_s"), F.col("dur")))
    weighted = profiles.record_weights(spans, [])
    return weighted.join(homes.select("uid", "wt_p"), "uid").withColumn("wt_total", F.col("wt") * F.col("wt_p"))


def segregation_from_visits(visits: DataFrame, home_counts: DataFrame, unit: str, share_a, share_b):
    """Visits to place metrics per half hour, and to what each person experiences."""
    bins = explode_bins(visits)
    metrics = place.zone_indices(bins, home_counts, unit, share_a, share_b)
    met = experienced.experienced(bins, metrics, unit)
    return metrics, met, experienced.person_mean(met)


def null_from_visits(visits: DataFrame, pois: DataFrame, metrics: DataFrame, unit: str, ids: list[str], n: int, pick):
    """Visits at tagged places to n replicates of their destinations, and the exposure in each replicate.

    Visits need x, y, tag, home and the unit, and keep their half hours as a span; the metrics are those of the observed visits.
    Both are stored once, as every replicate reads them. The mean over replicates comes from vectors; rows per replicate are made when they are read.
    """
    visits, metrics = cut(visits), cut(metrics)
    moving = nullmodel.movable(visits)
    pool = nullmodel.candidate_pool(moving, pois, unit)
    drawn = nullmodel.draw(moving, pool, ["x", "y", "tag"], unit, ids, n, pick)
    kept = visits.where(~((F.col("home") == 0) & F.col("tag").isNotNull()))
    shifted = nullmodel.merge_moved(kept, drawn, unit, n)
    met = experienced.experienced_spans(shifted, metrics, unit, ["sim"])
    numbers = replicates.numbered(metrics, unit)
    vectors = near_vectors(visits, pois, unit, ids, n, pick, numbers, SPAN)
    values = replicates.cells(metrics, numbers, unit, "ice_birth", experienced.CELL)
    return shifted, met, replicates.vector_mean(replicates.met_vectors(vectors, values, n))


#: What the exposure in replicates needs of a visit.
SPAN = ["uid", "weekday", "holiday", "time_span"]


def near_vectors(visits: DataFrame, pois: DataFrame, unit: str, ids: list[str], n: int, pick, numbers: DataFrame, more: list[str]) -> DataFrame:
    """The visits with the numbers of their n units in the model that keeps places near, and the columns `more`."""
    known = visits.join(numbers, unit, "left")
    pool = nullmodel.candidate_pool(nullmodel.movable(visits), pois, unit).join(numbers, unit, "left")
    drawn = replicates.draw_vector(nullmodel.movable(known), pool, ["x", "y", "tag"], unit, ids, n, pick, "no")
    return replicates.moved(drawn, known.where(~((F.col("home") == 0) & F.col("tag").isNotNull())), n, more)
