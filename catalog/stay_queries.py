"""Pings, stops, stays, profiles and homes."""

from pyspark.sql import functions as F

from catalog.fixtures import Tables, rd, rounded
from catalog.registry import query
from copresence.functions.constants import HOME_BOX, HOME_TIME_ZONE, T_MAX
from copresence.operators import cleaning, home, profiles, stays, stop_sweep

PING_ORDER = ["timestamp", "pid"]
STOP_ORDER = ["localtime", "sid"]


@query("ping_deltas", "W1 C19 K1", f"""SELECT pid, {rd('x - lag(x) OVER w')} AS xDelta, {rd('y - lag(y) OVER w')} AS yDelta,
    timestamp - lag(timestamp) OVER w AS tDelta,
    {rd('sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2))')} AS displacement FROM pings
    WINDOW w AS (PARTITION BY device_aid ORDER BY timestamp, pid)""")
def _(t: Tables):
    return rounded(stays.deltas(t.pings, PING_ORDER).select("pid", "xDelta", "yDelta", "tDelta", "displacement"),
                   "xDelta", "yDelta", "displacement")


GAP = """SELECT *, least(coalesce(lead(timestamp) OVER (PARTITION BY device_aid ORDER BY timestamp, pid), timestamp+1),
    timestamp+10800) AS until FROM pings"""
DENSE = "SELECT device_aid, x, y, pid, unnest(range(timestamp, until, 10799)) AS timestamp FROM gap"


@query("silent_period_fill", "W2", "SELECT device_aid, timestamp, pid, x, y FROM dense", gap=GAP, dense=DENSE)
def _(t: Tables):
    return stays.densify(t.pings, PING_ORDER, T_MAX).select("device_aid", "timestamp", "pid", "x", "y")


@query("location_runs", "W3", """SELECT pid, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) OVER
    (PARTITION BY device_aid ORDER BY timestamp, pid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS interval FROM (
    SELECT *, coalesce(loc = lag(loc) OVER w AND timestamp - lag(timestamp) OVER w < 259200, false) AS same
    FROM (SELECT p.*, s.loc % 3 AS loc FROM pings p JOIN stops s ON p.pid = s.sid)
    WINDOW w AS (PARTITION BY device_aid ORDER BY timestamp, pid))""")
def _(t: Tables):
    points = t.pings.join(t.stops.select(F.col("sid").alias("pid"), (F.col("loc") % 3).alias("loc")), "pid")
    return stays.run_id(points, PING_ORDER, 72 * 3600).select("pid", "interval")


RUNS = """SELECT *, sum(brk) OVER (PARTITION BY device_aid ORDER BY timestamp, pid ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN k = lag(k) OVER w AND timestamp - lag(timestamp) OVER w <= 10800 THEN 0 ELSE 1 END AS brk
    FROM (SELECT d.device_aid, d.timestamp, d.pid, s.lat, s.lng, s.loc AS k FROM dense d JOIN stops s ON s.sid = d.pid)
    WINDOW w AS (PARTITION BY device_aid ORDER BY timestamp, pid))"""
LABELLED = """SELECT *, CASE WHEN count(*) OVER w >= 2 AND max(timestamp) OVER w - min(timestamp) OVER w >= 900 THEN k ELSE -1 END AS label
    FROM runs WINDOW w AS (PARTITION BY device_aid, run)"""
INTERVALS = """SELECT *, sum(turn) OVER (PARTITION BY device_aid ORDER BY timestamp, pid ROWS UNBOUNDED PRECEDING) AS interval FROM (
    SELECT *, CASE WHEN label = lag(label) OVER w AND timestamp - lag(timestamp) OVER w < 10800 THEN 0 ELSE 1 END AS turn
    FROM labelled WINDOW w AS (PARTITION BY device_aid ORDER BY timestamp, pid))"""
KEPT = """SELECT device_aid, interval AS run, any_value(k) AS k, any_value(lat) AS lat, any_value(lng) AS lng, min(timestamp) AS s,
    max(timestamp) AS e, count(*) AS size FROM intervals WHERE label >= 0 GROUP BY 1, 2"""
STAY_STEPS = {"gap": GAP, "dense": DENSE, "runs": RUNS, "labelled": LABELLED, "intervals": INTERVALS, "kept": KEPT}


def stop_points(t: Tables):
    """Silences filled, then stops found on the denser trace."""
    crowded = stays.crowded_devices(t.pings)
    dense = stays.densify(stays.clean_pings(t.pings), PING_ORDER, T_MAX, crowded)
    return stays.detect_stops(dense, PING_ORDER, crowded=crowded)


@query("detected_stays", "W4 E1 A6", f"""SELECT device_aid, CAST(run AS BIGINT) AS interval,
    CAST(dense_rank() OVER (PARTITION BY device_aid ORDER BY first_run) AS INTEGER) AS loc, s AS start, e AS "end",
    {rd('lat')} AS latitude, {rd('lng')} AS longitude, size
    FROM (SELECT *, min(run) OVER (PARTITION BY device_aid, k) AS first_run FROM kept)""", **STAY_STEPS)
def _(t: Tables):
    out = stays.stays_from_points(stop_points(t))
    return rounded(out, "latitude", "longitude")


# the same steps for every longest silence of 1 to 12 hours
SWEEP = {
    "sgap": """SELECT *, least(coalesce(lead(timestamp) OVER (PARTITION BY t, device_aid ORDER BY timestamp, pid), timestamp + 1), timestamp + t) AS until
        FROM pings, (SELECT unnest(range(1, 13))*3600 AS t)""",
    "sdense": "SELECT t, device_aid, pid, unnest(range(timestamp, until, t - 1)) AS timestamp FROM sgap",
    "sruns": """SELECT *, sum(brk) OVER (PARTITION BY t, device_aid ORDER BY timestamp, pid ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN k = lag(k) OVER w AND timestamp - lag(timestamp) OVER w <= t THEN 0 ELSE 1 END AS brk
        FROM (SELECT d.*, s.loc AS k FROM sdense d JOIN stops s ON s.sid = d.pid) WINDOW w AS (PARTITION BY t, device_aid ORDER BY timestamp, pid))""",
    "slabel": """SELECT *, CASE WHEN count(*) OVER w >= 2 AND max(timestamp) OVER w - min(timestamp) OVER w >= 900 THEN k ELSE -1 END AS label
        FROM sruns WINDOW w AS (PARTITION BY t, device_aid, run)""",
    "sinterval": """SELECT *, sum(turn) OVER (PARTITION BY t, device_aid ORDER BY timestamp, pid ROWS UNBOUNDED PRECEDING) AS interval FROM (
        SELECT *, CASE WHEN label = lag(label) OVER w AND timestamp - lag(timestamp) OVER w < t THEN 0 ELSE 1 END AS turn
        FROM slabel WINDOW w AS (PARTITION BY t, device_aid ORDER BY timestamp, pid))""",
    "sstay": """SELECT t, dur, CASE WHEN dur > 0 THEN size/(dur/60) ELSE 'inf'::DOUBLE END AS sfre FROM (
        SELECT t, (max(timestamp) - min(timestamp))/60.0e0 AS dur, count(*) AS size FROM sinterval WHERE label >= 0 GROUP BY t, device_aid, interval)""",
}


@query("stay_stats_by_gap", "E2", f"""SELECT CAST(t/3600 AS INTEGER) AS hours, count(*) AS stays, {rd('min(dur)')} AS dur_min, {rd('max(dur)')} AS dur_max, {rd('median(dur)')} AS dur_med,
    {rd('avg(CASE WHEN dur >= t/60 THEN 1 ELSE 0 END)')} AS dur_thre, {rd('min(sfre)')} AS sfre_min, {rd('max(sfre)')} AS sfre_max, {rd('median(sfre)')} AS sfre_med,
    {rd('avg(CASE WHEN sfre >= 1 THEN 1 ELSE 0 END)')} AS sfre_one FROM sstay GROUP BY t""", **SWEEP)
def _(t: Tables):
    swept = stop_sweep.sweep(stays.clean_pings(t.pings), PING_ORDER, [h * 3600 for h in range(1, 13)])
    return rounded(stop_sweep.sweep_stats(swept), "dur_min", "dur_max", "dur_med", "dur_thre", "sfre_min", "sfre_max", "sfre_med", "sfre_one")


LEAVING = "localtime + to_microseconds(CAST(round(dur*60000000) AS BIGINT))"


def timed(t: Tables):
    return t.stops.withColumn("leaving_localtime", F.timestamp_add("MICROSECOND", F.round(F.col("dur") * 60000000).cast("bigint"), F.col("localtime")))


@query("user_stats", "E3 U3", f"""SELECT uid, count(DISTINCT loc) AS num_loc, count(*) AS num_stays, any_value(nd) AS num_days,
    {rd('median(dur)')} AS dur_median FROM stops JOIN (SELECT uid, count(DISTINCT d) AS nd FROM (
    SELECT uid, CAST(localtime AS DATE) AS d FROM stops UNION SELECT uid, CAST({LEAVING} AS DATE) FROM stops) GROUP BY 1) d USING (uid) GROUP BY 1""")
def _(t: Tables):
    return rounded(stays.user_stats(timed(t)), "dur_median")


@query("monthly_counts", "E4", """SELECT CAST(month(localtime) AS INTEGER) AS month, count(*) AS stays, count(DISTINCT uid) AS devices
    FROM stops GROUP BY 1""")
def _(t: Tables):
    return stays.monthly(t.stops).withColumn("stays", F.col("stays").cast("long"))


@query("stay_times", "C6 C10", f"""SELECT sid, CAST(floor(epoch(localtime)) AS BIGINT) AS "start",
    CAST(floor(epoch({LEAVING})) AS BIGINT) AS "end",
    (CAST(floor(epoch({LEAVING})) AS BIGINT) - CAST(floor(epoch(localtime)) AS BIGINT))/60.0e0 AS dur,
    CAST(month(localtime) AS INTEGER) AS month, CASE WHEN CAST({LEAVING} AS DATE) <> day THEN 1 ELSE 0 END AS cross_day FROM stops""")
def _(t: Tables):
    s = stays.add_dates(timed(t).drop("dur")).select(
        "sid", "month", "cross_day", F.unix_seconds(F.col("localtime").cast("timestamp")).alias("start"),
        F.unix_seconds(F.col("leaving_localtime").cast("timestamp")).alias("end"))
    return stays.stay_times(s).select("sid", "start", "end", "dur", "month", "cross_day")


BOX = HOME_BOX


@query("local_time_flags", "C7 C8 C9", """SELECT sid, tzname, lt AS localtime, hour(lt) + minute(lt)/60.0e0 AS h_s,
    CASE WHEN lt > TIMESTAMP '2024-01-08' AND lt < TIMESTAMP '2024-01-15' OR lt > TIMESTAMP '2024-01-28' THEN 1 ELSE 0 END AS holiday_s,
    CASE WHEN isodow(lt) >= 6 THEN 0 ELSE 1 END AS weekday_s FROM (
    SELECT sid, CASE WHEN home THEN 'Europe/Stockholm' ELSE 'Europe/Helsinki' END AS tzname,
        localtime + CASE WHEN home THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS lt
    FROM (SELECT *, lat BETWEEN 55.3617373725e0 AND 69.1062472602e0 AND lng BETWEEN 11.0273686052e0 AND 23.9033785336e0 AND lng < 16 AS home FROM stops))""")
def _(t: Tables):
    box = {**BOX, "east": 15.95}
    east = t.spark.createDataFrame(
        [("Europe/Helsinki", [(15.95, 50.0), (40.0, 50.0), (40.0, 75.0), (15.95, 75.0)])],
        "tzname string, ring array<struct<x:double,y:double>>")
    named = stays.zone_names(t.stops.withColumnRenamed("localtime", "utc"), box, HOME_TIME_ZONE, east)
    local = stays.to_local(named, "utc", "tzname", "localtime").withColumn("leaving_localtime", F.col("localtime"))
    out = stays.enrich_time(local, [("2024-01-08 00:00:00", "2024-01-15 00:00:00"), ("2024-01-28 00:00:00", None)])
    return out.select("sid", "tzname", "localtime", "h_s", "holiday_s", "weekday_s")


@query("stay_sequence", "W5", "SELECT sid, row_number() OVER (PARTITION BY uid ORDER BY localtime, sid) AS seq FROM stops")
def _(t: Tables):
    return stays.add_seq(t.stops, "day", STOP_ORDER).select("sid", "seq")


@query("pings_in_stays", "D11", f"""SELECT p.pid, s.sid FROM pings p JOIN (SELECT uid, sid, CAST(floor(epoch(localtime)) AS BIGINT) AS s0,
    CAST(floor(epoch({LEAVING})) AS BIGINT) AS s1 FROM stops) s ON p.device_aid = s.uid AND p.timestamp BETWEEN s0 AND s1""")
def _(t: Tables):
    intervals = timed(t).select(
        F.col("uid").alias("device_aid"), "sid", F.unix_seconds(F.col("localtime").cast("timestamp")).alias("start"),
        F.unix_seconds(F.col("leaving_localtime").cast("timestamp")).alias("end"))
    return stays.label_pings(t.pings.select("device_aid", "timestamp", "pid"), intervals).select("pid", "sid")


@query("home_stays", "D12", """SELECT s.sid, CASE WHEN h.uid IS NULL THEN 0 ELSE 1 END AS home FROM stops s
    LEFT JOIN home_points h ON s.uid = h.uid AND s.lat = h.home_lat AND s.lng = h.home_lng""")
def _(t: Tables):
    return stays.flag_home(t.stops, t.home_points).select("sid", "home")


# profiles, clusters and homes

@query("activity_profiles", "E6", """SELECT activity, CAST(b.b AS INTEGER) AS half_hour, count(p.b) AS freq
    FROM (SELECT unnest(range(48)) AS b) b CROSS JOIN (SELECT unnest(['all','holiday','non_holiday']) AS activity) a
    LEFT JOIN (SELECT holiday, unnest(range(plo, phi+1)) % 48 AS b FROM prange) p ON p.b = b.b AND
    (activity = 'all' OR (activity = 'holiday') = (holiday = 1)) GROUP BY 1, 2""")
def _(t: Tables):
    return profiles.activity_profiles(t.stops)


@query("peak_scaled_profile", "E6", f"""SELECT kind, half_hour, {rd('freq*1.0e0/max(freq) OVER (PARTITION BY kind)')} AS freq FROM (
    SELECT kind, CAST(b AS INTEGER) AS half_hour, count(*) AS freq FROM (SELECT kind, unnest(range(plo, phi+1)) % 48 AS b FROM prange) GROUP BY 1, 2)""")
def _(t: Tables):
    return rounded(profiles.tempo(t.stops, ["kind"], norm=True), "freq")


# the weight of a person's own profile
OWN = """SELECT p.*, w.wt FROM prange p JOIN (SELECT r.sid, sum(i.inv) AS wt FROM
    (SELECT sid, uid, unnest(range(plo, least(phi,47)+1)) AS b FROM prange) r
    JOIN (SELECT uid, b, max(c) OVER (PARTITION BY uid)*1.0e0/c AS inv FROM (SELECT uid, b % 48 AS b, count(*) AS c FROM
        (SELECT uid, unnest(range(plo, phi+1)) AS b FROM prange) GROUP BY 1, 2)) i ON i.uid = r.uid AND i.b = r.b GROUP BY 1) w USING (sid)"""
CLUSTERS = "SELECT uid, loc, holiday, count(*) AS freq, sum(wt) AS freq_wt, sum(dur) AS dur FROM own GROUP BY 1, 2, 3"
TOP = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(freq_wt, 6) DESC, loc) AS rk FROM clusters
    WHERE holiday = 0) WHERE rk <= 3"""
TEMPO3 = """SELECT uid, loc, b % 48 AS half_hour, count(*) AS c, sum(wt) AS cw FROM
    (SELECT o.uid, o.loc, o.wt, unnest(range(plo, phi+1)) AS b FROM own o JOIN top3 t ON o.uid = t.uid AND o.loc = t.loc) GROUP BY 1, 2, 3"""
SCALED = """SELECT uid, loc, half_hour, c*1.0e0/max(c) OVER (PARTITION BY uid, loc) AS freq, cw/max(cw) OVER (PARTITION BY uid, loc) AS freq_wt FROM tempo3"""
STAY_CTES = dict(own=OWN, clusters=CLUSTERS, top3=TOP, tempo3=TEMPO3, scaled=SCALED)


def own_weights(t: Tables):
    return profiles.record_weights(t.stops, ["uid"])


def clusters(t: Tables):
    return rounded(profiles.cluster_stats(own_weights(t)), "freq_wt")


def top_tempo(t: Tables):
    top = profiles.top_clusters(clusters(t)).select("uid", "loc")
    return profiles.tempo_weighted(own_weights(t).join(top, ["uid", "loc"]), ["uid", "loc"])


@query("cluster_stats", "E9", f"SELECT uid, loc, holiday, freq, {rd('freq_wt')} AS freq_wt, {rd('dur')} AS dur FROM clusters", **STAY_CTES)
def _(t: Tables):
    return rounded(clusters(t), "dur")


@query("top_clusters", "W6", f"SELECT uid, loc, {rd('freq_wt')} AS freq_wt FROM top3", **STAY_CTES)
def _(t: Tables):
    return profiles.top_clusters(clusters(t)).select("uid", "loc", "freq_wt")


@query("cluster_profiles", "E7", f"""SELECT f.uid, f.loc, f.half_hour, {rd('coalesce(s.freq, 0)')} AS freq, {rd('coalesce(s.freq_wt, 0)')} AS freq_wt
    FROM (SELECT uid, loc, CAST(unnest(range(48)) AS INTEGER) AS half_hour FROM top3) f LEFT JOIN scaled s USING (uid, loc, half_hour)""", **STAY_CTES)
def _(t: Tables):
    return rounded(top_tempo(t), "freq", "freq_wt")


SCORES = """SELECT uid, loc, round(coalesce(sum(freq_wt) FILTER (half_hour <= 11 OR half_hour >= 44), 0), 6) AS home_freq,
    coalesce(sum(freq_wt) FILTER (half_hour <= 11 OR half_hour >= 44), 0)/sum(freq_wt)*100 AS home_share FROM scaled GROUP BY 1, 2"""


def scores(t: Tables):
    return rounded(home.home_scores(top_tempo(t)), "home_freq")


@query("home_scores", "E10", f"SELECT uid, loc, {rd('home_freq')} AS home_freq, {rd('home_share')} AS home_share FROM scores", **STAY_CTES, scores=SCORES)
def _(t: Tables):
    return rounded(scores(t), "home_share")


PICKED = """SELECT uid, loc AS home, home_freq, home_share FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY home_freq DESC, loc) AS rk
    FROM scores WHERE home_freq > 0) WHERE rk = 1"""


@query("picked_homes", "W7", f"SELECT uid, home, {rd('home_freq')} AS home_freq, {rd('home_share')} AS home_share FROM picked",
       **STAY_CTES, scores=SCORES, picked=PICKED)
def _(t: Tables):
    return rounded(home.pick_home(scores(t)), "home_share")


@query("reliable_homes", "B22 D1", f"""SELECT p.uid, home, c.freq FROM picked p JOIN clusters c ON c.uid = p.uid AND c.loc = p.home
    WHERE c.holiday = 0 AND c.freq >= 2""", **STAY_CTES, scores=SCORES, picked=PICKED)
def _(t: Tables):
    seen = clusters(t).where("holiday = 0").select("uid", F.col("loc").alias("home"), "freq")
    return home.reliable_home(home.pick_home(scores(t)).join(seen, ["uid", "home"]), 2).select("uid", "home", "freq")


@query("device_weights", "E11", f"""SELECT deso, devices, {rd('w')} AS wt_raw, {rd('cut')} AS wt_cut, {rd('least(w, cut)')} AS wt_p FROM (
    SELECT *, sqrt(pow(stddev_pop(w) OVER ()/avg(w) OVER (), 2) + 1)*3.5e0*median(w) OVER () AS cut FROM (
    SELECT deso, count(*) AS devices, any_value(z.pop)*1.0e0/count(*) AS w FROM homes h JOIN zones z USING (deso) GROUP BY 1))""")
def _(t: Tables):
    return rounded(home.device_weights(t.homes, t.zones), "wt_raw", "wt_cut", "wt_p")


@query("sampling_coverage", "E12", f"""SELECT z.deso, z.pop, coalesce(h.n, 0) AS devices, {rd('coalesce(h.n, 0)*100.0e0/z.pop')} AS share
    FROM zones z LEFT JOIN (SELECT deso, count(*) AS n FROM homes GROUP BY 1) h USING (deso)""")
def _(t: Tables):
    return rounded(home.coverage(t.homes, t.zones), "share")


@query("coverage_summary", "E12 E39 E52", f"""SELECT count(*) AS zones, {rd('avg(share)')} AS mean, {rd('stddev_samp(share)')} AS std, {rd('min(share)')} AS low, {rd('quantile_cont(share, 0.25)')} AS q25,
    {rd('median(share)')} AS q50, {rd('quantile_cont(share, 0.75)')} AS q75, {rd('max(share)')} AS high, {rd('CASE WHEN min(rp) < max(rp) AND min(rv) < max(rv) THEN corr(rp, rv) END')} AS rho FROM (SELECT *,
    rank() OVER (ORDER BY pop) + (count(*) OVER (PARTITION BY pop) - 1)/2.0e0 AS rp, rank() OVER (ORDER BY devices) + (count(*) OVER (PARTITION BY devices) - 1)/2.0e0 AS rv FROM covered)""",
       covered="SELECT z.deso, z.pop, coalesce(h.n, 0) AS devices, coalesce(h.n, 0)*100.0e0/z.pop AS share FROM zones z LEFT JOIN (SELECT deso, count(*) AS n FROM homes GROUP BY 1) h USING (deso)")
def _(t: Tables):
    from copresence.operators import compare
    covered = home.coverage(t.homes, t.zones).withColumn("country", F.lit(1))
    out = compare.describe(covered, ["country"], "share").join(compare.spearman(covered, ["country"], "pop", "devices").select("country", "rho"), "country")
    names = {"count": "zones", "min": "low", "max": "high"}
    return rounded(out.withColumnsRenamed(names).select("zones", "mean", "std", "low", "q25", "q50", "q75", "high", "rho"), "mean", "std", "low", "q25", "q50", "q75", "high", "rho")


@query("total_over_group", "W10 E35", f"""SELECT uid, loc, freq, {rd('freq*1.0e0/sum(freq) OVER (PARTITION BY uid)')} AS share
    FROM (SELECT uid, loc, count(*) AS freq FROM stops GROUP BY 1, 2)""")
def _(t: Tables):
    from copresence.operators.mobility import share_within
    return rounded(share_within(t.stops.groupBy("uid", "loc").agg(F.count(F.lit(1)).alias("freq")), ["uid"], "freq", "share"), "share")


@query("quality_filtered_stops", "B4 D5", """SELECT s.sid FROM stops s JOIN (SELECT uid, count(DISTINCT day) AS nd, count(DISTINCT loc) AS nl
    FROM stops GROUP BY 1) u USING (uid) WHERE nd > 20 AND nl > 40 AND dur < 240""")
def _(t: Tables):
    u = stays.user_stats(t.stops, end="localtime")
    return cleaning.quality_filter(t.stops, u, t.homes, 20, 40, 240).select("sid")
