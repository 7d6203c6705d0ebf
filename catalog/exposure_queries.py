"""Experienced segregation and contacts."""

from pyspark.sql import functions as F

from catalog.fixtures import Tables, r6, rd, rd3, rounded
from catalog.place_queries import METRICS, cells_sql, metrics
from catalog.registry import query
from copresence.functions.constants import RANDOM_MIX
from copresence.operators import experienced, mobility, place, stays

CELL = "weekday, holiday, time_seq"
DESO = dict(cells=cells_sql("deso"), metrics=METRICS)
LOC = dict(cells=cells_sql("loc"), metrics=METRICS)
EXP = f"""SELECT b.uid, b.weekday, b.holiday, b.time_seq, median(m.ice_birth) AS ice_birth, median(m.evenness_income) AS evenness_income,
    avg(m.num_unique_uid) AS num_coexistence FROM bins b JOIN metrics m ON m.unit = b.deso AND m.weekday = b.weekday AND m.holiday = b.holiday
    AND m.time_seq = b.time_seq GROUP BY 1, 2, 3, 4"""


def exp(t: Tables):
    return experienced.experienced(t.bins, metrics(t), "deso")


@query("experienced_segregation", "E28 D7", f"""SELECT uid, weekday, holiday, time_seq, {rd('ice_birth')} AS ice_birth,
    {rd('evenness_income')} AS evenness_income, {rd('num_coexistence')} AS num_coexistence FROM exped""", exped=EXP, **DESO)
def _(t: Tables):
    return rounded(exp(t), "ice_birth", "evenness_income", "num_coexistence")


@query("experienced_by_type", "E29", f"""SELECT b.uid, b.weekday, b.holiday, b.time_seq, b.kind, {rd('median(m.ice_birth)')} AS ice_birth,
    {rd('median(m.evenness_income)')} AS evenness_income, {rd('avg(m.num_unique_uid)')} AS num_coexistence FROM bins b JOIN metrics m ON m.unit = b.deso
    AND m.weekday = b.weekday AND m.holiday = b.holiday AND m.time_seq = b.time_seq GROUP BY 1, 2, 3, 4, 5""", **DESO)
def _(t: Tables):
    out = experienced.experienced(t.bins, metrics(t), "deso", ["kind"])
    return rounded(out, "ice_birth", "evenness_income", "num_coexistence")


@query("person_average_day", "E32", f"""SELECT uid, weekday, holiday, {rd('avg(ice_birth)')} AS ice_e, {rd('avg(evenness_income)')} AS evenness_e
    FROM exped GROUP BY 1, 2, 3""", exped=EXP, **DESO)
def _(t: Tables):
    return rounded(experienced.person_mean(exp(t)), "ice_e", "evenness_e")


@query("place_halfhour_segregation", "E27 B7", f"""SELECT weekday, holiday, unit AS loc, time_seq, num_visits, num_unique_uid,
    {rd('num_visits_wt')} AS num_visits_wt, {rd('evenness_income')} AS evenness_income, {rd('ice_birth')} AS ice_birth FROM metrics""",
       cells=cells_sql("loc").replace("FROM bins b", "FROM (SELECT b.* FROM bins b JOIN home_points hp ON hp.uid = b.uid WHERE NOT (b.lat = hp.home_lat AND b.lng = hp.home_lng)) b"),
       metrics=METRICS)
def _(t: Tables):
    away = stays.flag_home(t.bins, t.home_points).where("home = 0")
    return rounded(metrics(t, "loc", away), "num_visits_wt", "evenness_income", "ice_birth")


UNIT = "CASE WHEN deso%3 = 0 THEN concat('z', deso) ELSE concat('h', loc) END"


@query("mixed_unit_segregation", "E26", f"""SELECT weekday, holiday, unit, time_seq, num_visits, num_unique_uid,
    {rd('num_visits_wt')} AS num_visits_wt, {rd('evenness_income')} AS evenness_income, {rd('ice_birth')} AS ice_birth FROM metrics""",
       cells=cells_sql("unit").replace("FROM bins b", f"FROM (SELECT *, {UNIT} AS unit FROM bins) b"), metrics=METRICS)
def _(t: Tables):
    whole = F.when(F.col("deso") % 3 == 0, "0").otherwise(F.concat(F.lit("h"), "loc"))
    b = t.bins.withColumn("unit", place.unit_id(F.concat(F.lit("z"), "deso"), whole))
    return rounded(metrics(t, "unit", b), "num_visits_wt", "evenness_income", "ice_birth")


@query("unit_mean_index", "E33 B23", f"""SELECT unit AS loc, {rd('sum(ice_birth*num_visits_wt)/sum(num_visits_wt)')} AS ice_birth,
    {rd('sum(evenness_income*num_visits_wt)/sum(num_visits_wt)')} AS evenness_income FROM metrics WHERE num_unique_uid >= 2 GROUP BY 1""", **LOC)
def _(t: Tables):
    return rounded(place.unit_ice(metrics(t, "loc"), "loc", 2), "ice_birth", "evenness_income")


@query("busy_places", "B23", "SELECT unit AS loc, CAST(sum(num_visits) AS BIGINT) AS visits FROM metrics GROUP BY 1 HAVING sum(num_visits) > 300", **LOC)
def _(t: Tables):
    return place.busy_places(metrics(t, "loc"), "loc", 300)


BUSYCELLS = "SELECT * FROM metrics WHERE num_unique_uid >= 3"


@query("missing_place_share", "D8", f"""SELECT CAST(count(*) AS BIGINT) AS visits, {rd('count(*) FILTER (m.unit IS NULL)*100.0e0/count(*)')} AS missing FROM bins b LEFT JOIN kept m
    ON m.unit = b.loc AND m.weekday = b.weekday AND m.holiday = b.holiday AND m.time_seq = b.time_seq""", kept=BUSYCELLS, **LOC)
def _(t: Tables):
    kept = metrics(t, "loc").where("num_unique_uid >= 3")
    return rounded(experienced.missing_share(t.bins, kept, "loc"), "missing")


HOMEICE = "SELECT uid, ice_r FROM groups"


@query("home_or_place_index", "D9 D10", f"""SELECT b.uid, b.time_seq, count(*) AS n, {rd('sum(CASE WHEN b.lat = hp.home_lat AND b.lng = hp.home_lng THEN g.ice_r ELSE m.ice_birth END)')} AS ice
    FROM bins b JOIN home_points hp ON hp.uid = b.uid LEFT JOIN groups g ON g.uid = b.uid LEFT JOIN metrics m ON m.unit = b.loc AND m.weekday = b.weekday AND m.holiday = b.holiday AND m.time_seq = b.time_seq
    GROUP BY 1, 2""", **LOC)
def _(t: Tables):
    flagged = stays.flag_home(t.bins, t.home_points)
    out = experienced.home_or_place(flagged, t.groups, metrics(t, "loc"), "loc")
    return out.groupBy("uid", "time_seq").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("ice")).alias("ice"))


@query("person_place_links", "E58 C14", f"SELECT uid, loc, {rd('sum(wt_total)')} AS weight FROM bins GROUP BY 1, 2")
def _(t: Tables):
    return rounded(place.links_from_spans(t.visits, "loc"), "weight")


@query("timed_links", "E59", f"SELECT uid, loc, time_seq, {rd('sum(wt_total)')} AS weight FROM bins GROUP BY 1, 2, 3")
def _(t: Tables):
    return rounded(place.links(t.bins, "loc", ["time_seq"]), "weight")


MIX = """SELECT loc, time_seq, sum(wt_p) FILTER (grp_r='F') AS f, sum(wt_p) FILTER (grp_r='D') AS d, sum(wt_p) FILTER (grp_r='N') AS n
    FROM (SELECT DISTINCT b.uid, b.loc, b.time_seq, g.wt_p, g.grp_r FROM bins b JOIN groups g ON g.uid = b.uid) GROUP BY 1, 2"""
CONTACT = """SELECT l.uid, sum(coalesce(f,0)) AS f, sum(coalesce(d,0)) AS d, sum(coalesce(n,0)) AS n FROM
    (SELECT uid, loc, time_seq, sum(wt_total) AS w FROM bins GROUP BY 1, 2, 3) l LEFT JOIN mix m USING (loc, time_seq) GROUP BY 1"""
SHARES = "SELECT uid, f/(f+d+n)*100 AS f, d/(f+d+n)*100 AS d, n/(f+d+n)*100 AS n FROM contact"


def mix(t: Tables):
    return experienced.group_mix_of_cells(t.bins, t.groups, ["loc", "time_seq"])


def contact(t: Tables):
    return experienced.person_contact(place.links(t.bins, "loc", ["time_seq"]), mix(t), ["loc", "time_seq"])


@query("place_group_mix", "E60", f"""SELECT loc, time_seq, {rd('coalesce(f,0)')} AS f, {rd('coalesce(d,0)')} AS d, {rd('coalesce(n,0)')} AS n FROM mix""", mix=MIX)
def _(t: Tables):
    return rounded(mix(t), "f", "d", "n")


@query("person_contacts", "E61", f"SELECT uid, {rd3('f')} AS f, {rd3('d')} AS d, {rd3('n')} AS n FROM contact", mix=MIX, contact=CONTACT)
def _(t: Tables):
    return rounded(contact(t), "f", "d", "n", digits=3)


@query("weighted_contacts", "E61", f"""SELECT l.uid, {rd3('sum(coalesce(f,0)*w)')} AS f, {rd3('sum(coalesce(d,0)*w)')} AS d, {rd3('sum(coalesce(n,0)*w)')} AS n FROM
    (SELECT uid, loc, time_seq, sum(wt_total) AS w FROM bins GROUP BY 1, 2, 3) l LEFT JOIN mix m USING (loc, time_seq) GROUP BY 1""", mix=MIX)
def _(t: Tables):
    out = experienced.person_contact(place.links(t.bins, "loc", ["time_seq"]), mix(t), ["loc", "time_seq"], by_weight=True)
    return rounded(out, "f", "d", "n", digits=3)


@query("contact_shares", "E62", f"SELECT uid, {rd('f')} AS f, {rd('d')} AS d, {rd('n')} AS n FROM shared", mix=MIX, contact=CONTACT, shared=SHARES)
def _(t: Tables):
    return rounded(experienced.contact_shares(contact(t), ["uid"]), "f", "d", "n")


@query("typed_contacts", "E62", f"""SELECT uid, {rd('wt_p')} AS wt_p, grp_r, {rd('value')} AS value, concat(grp_r, o) AS inter_type,
    CASE WHEN grp_r = o THEN 1 WHEN grp_r <> 'N' AND o <> 'N' THEN 2 ELSE 3 END AS kind FROM (
    SELECT s.uid, g.wt_p, g.grp_r, unnest(['F','D','N']) AS o, unnest([f-17.6e0, d-42.3e0, n-40.1e0]) AS value FROM shared s JOIN groups g USING (uid))""",
       mix=MIX, contact=CONTACT, shared=SHARES)
def _(t: Tables):
    people = experienced.contact_shares(contact(t), ["uid"]).join(t.groups.select("uid", "wt_p", "grp_r"), "uid")
    return rounded(experienced.typed_pairs(people, RANDOM_MIX), "wt_p", "value")


@query("contacts_without_self", "E61", f"""SELECT c.uid, {rd3("f - CASE WHEN grp_r='F' THEN wt_p*k ELSE 0 END")} AS f, {rd3("d - CASE WHEN grp_r='D' THEN wt_p*k ELSE 0 END")} AS d,
    {rd3("n - CASE WHEN grp_r='N' THEN wt_p*k ELSE 0 END")} AS n FROM contact c JOIN groups g USING (uid) JOIN (SELECT uid, count(DISTINCT (loc, time_seq)) AS k FROM bins GROUP BY 1) USING (uid)""",
       mix=MIX, contact=CONTACT)
def _(t: Tables):
    n = t.bins.select("uid", "loc", "time_seq").distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("cells"))
    return rounded(experienced.without_self(contact(t), t.groups, n), "f", "d", "n", digits=3)


@query("time_shares_by_group", "E71", f"""SELECT kind, {rd("coalesce(max(s) FILTER (grp_r='D'),0)")} AS D, {rd("coalesce(max(s) FILTER (grp_r='F'),0)")} AS F,
    {rd("coalesce(max(s) FILTER (grp_r='N'),0)")} AS N, {rd("coalesce(max(s) FILTER (grp_r='D'),0)-coalesce(max(s) FILTER (grp_r='F'),0)")} AS d_minus_f FROM (
    SELECT grp_r, kind, sum(dur*wt_p)/sum(sum(dur*wt_p)) OVER (PARTITION BY grp_r) AS s FROM stops JOIN groups USING (uid) GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables):
    return rounded(experienced.time_shares(t.stops, t.groups), "D", "F", "N", "d_minus_f")


@query("home_time_share", "E71", f"""SELECT uid, {rd('sum(CASE WHEN lat = home_lat AND lng = home_lng THEN dur ELSE 0 END)/sum(dur)')} AS home_share
    FROM stops JOIN home_points USING (uid) GROUP BY 1""")
def _(t: Tables):
    return rounded(experienced.home_time(stays.flag_home(t.stops, t.home_points)), "home_share")


@query("mobility_metrics", "E56 W12", f"""SELECT uid, number_of_locations, number_of_visits, {rd('average_displacement')} AS average_displacement,
    {rd('radius_of_gyration')} AS radius_of_gyration, {rd('median_distance_from_home')} AS median_distance_from_home FROM mobility""")
def _(t: Tables):
    return rounded(t.mobility, "average_displacement", "radius_of_gyration", "median_distance_from_home")


KM = "(sqrt(pow(x-hx,2)+pow(y-hy,2))/10)"


@query("distance_decay", "E55 C20", f"""SELECT grp_r, d, {rd('w/sum(w) OVER (PARTITION BY grp_r)')} AS fd FROM (SELECT grp_r, CAST(ceil({KM}) AS INTEGER) AS d, sum(wt_p) AS w
    FROM stops JOIN home_points USING (uid) JOIN (SELECT uid, wt_p, unnest(['All', grp_r]) AS grp_r FROM groups) g USING (uid) WHERE {KM} > 0 AND {KM} <= 1500 GROUP BY 1, 2)""")
def _(t: Tables):
    from copresence.functions.distance import planar
    g = t.groups.select("uid", "wt_p", F.explode(F.array(F.lit("All"), "grp_r")).alias("grp_r"))
    v = t.stops.join(t.home_points, "uid").join(g, "uid").withColumn(
        "km", planar(F.col("x"), F.col("y"), F.col("hx"), F.col("hy")) / 10)
    return rounded(mobility.distance_decay(v, "km", "wt_p", ["grp_r"]), "fd")
