"""The chains from pings to exposure as single queries."""

from pyspark.sql import functions as F

from catalog.exposure_queries import DESO, EXP
from catalog.fixtures import Tables, rd, rounded
from catalog.null_queries import NULLS, REPLICATES, UNDER, arithmetic, unit_visits, upois
from catalog.place_queries import home_counts, shares
from catalog.registry import query
from catalog.stay_queries import BOX, PICKED, PING_ORDER, SCORES, STAY_CTES, STAY_STEPS
from copresence.functions.constants import HOME_TIME_ZONE
from copresence.plans import flows

SEASONS = [("2024-01-08 00:00:00", "2024-01-15 00:00:00"), ("2024-01-28 00:00:00", None)]


@query("clean_stays", "W4 E1 B3 C6 C7 C8 C9 W5", f"""SELECT uid, CAST(run AS BIGINT) AS interval, CAST(loc AS INTEGER) AS loc, (e-s)/60.0e0 AS dur, lt AS localtime, hour(lt)+minute(lt)/60.0e0 AS h_s,
    CASE WHEN lt > TIMESTAMP '2024-01-08' AND lt < TIMESTAMP '2024-01-15' OR lt > TIMESTAMP '2024-01-28' THEN 1 ELSE 0 END AS holiday_s, CASE WHEN isodow(lt) >= 6 THEN 0 ELSE 1 END AS weekday_s,
    row_number() OVER (PARTITION BY uid ORDER BY s, run) AS seq FROM (
    SELECT *, device_aid AS uid, make_timestamp(s*1000000) + INTERVAL 1 HOUR AS lt, dense_rank() OVER (PARTITION BY device_aid ORDER BY first_run) AS loc FROM (SELECT *, min(run) OVER (PARTITION BY device_aid, k) AS first_run FROM kept))
    WHERE NOT (lat, lng) IN (SELECT (home_lat, home_lng) FROM home_points WHERE uid < 3)""", **STAY_STEPS)
def _(t: Tables):
    abnormal = t.home_points.where("uid < 3").select(F.col("home_lat").alias("lat"), F.col("home_lng").alias("lng"))
    out = flows.stays_from_pings(t.pings, PING_ORDER, BOX, HOME_TIME_ZONE, SEASONS, abnormal)
    return out.select("uid", "interval", "loc", "dur", "localtime", "h_s", "holiday_s", "weekday_s", "seq")


@query("detected_home_weights", "E7 E8 E9 E10 E11 W6 W7 B22", f"""SELECT h.uid, h.home, h.deso, {rd('least(w, cut)')} AS wt_p FROM reliable h JOIN (
    SELECT deso, w, sqrt(pow(stddev_pop(w) OVER ()/avg(w) OVER (), 2) + 1)*3.5e0*median(w) OVER () AS cut FROM (SELECT r.deso, any_value(z.pop)*1.0e0/count(*) AS w FROM reliable r JOIN zones z ON z.deso = r.deso GROUP BY 1)) USING (deso)""",
       **STAY_CTES, scores=SCORES, picked=PICKED,
       reliable="SELECT p.uid, p.home, p.home % 25 AS deso FROM picked p JOIN clusters c ON c.uid = p.uid AND c.loc = p.home WHERE c.holiday = 0 AND c.freq >= 1")
def _(t: Tables):
    out = flows.homes_from_stays(t.stops, t.zones, F.col("home") % 25, 1)
    return rounded(out.select("uid", "home", "deso", "wt_p"), "wt_p")


@query("exposure_from_visits", "E25 E28 E32", f"""SELECT uid, weekday, holiday, {rd('avg(ice_birth)')} AS ice_e, {rd('avg(evenness_income)')} AS evenness_e
    FROM exped GROUP BY 1, 2, 3""", exped=EXP, **DESO)
def _(t: Tables):
    sa, sb = shares(t)
    visits = flows.visits_from_stays(t.stops, t.weights)
    return rounded(flows.segregation_from_visits(visits, home_counts(t), "deso", sa, sb)[2], "ice_e", "evenness_e")


@query("exposure_under_null", "N1 N2 N4 N6 E30 E31", f"SELECT uid, weekday, holiday, {rd('avg(v)')} AS ice_birth FROM (SELECT uid, weekday, holiday, time_seq, avg(ice) AS v FROM under1 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
       **NULLS, **UNDER)
def _(t: Tables):
    visits, metrics = unit_visits(t)
    return rounded(flows.null_from_visits(visits, upois(t), metrics, "unit", ["sid"], REPLICATES, arithmetic)[2], "ice_birth")
