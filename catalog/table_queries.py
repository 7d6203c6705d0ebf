"""Filters, labels, joins and reshapes."""

from pyspark.sql import functions as F

from catalog.fixtures import TAGS, Tables, rd, rounded
from catalog.place_queries import KNOTS
from catalog.registry import query
from copresence.functions import indices, labels, poi_types, text
from copresence.functions.time_bins import span_bins, stay_span
from copresence.operators import cleaning, features, residential

BAD_COORDS = "SELECT pid, latitude + pid%40 AS latitude, longitude*(pid%17) AS longitude FROM pings"


@query("valid_coordinates", "B2", "SELECT pid FROM moved WHERE latitude BETWEEN -80 AND 84 AND longitude BETWEEN -180 AND 180", moved=BAD_COORDS)
def _(t: Tables):
    p = t.pings.select("pid", (F.col("latitude") + F.col("pid") % 40).alias("latitude"), (F.col("longitude") * (F.col("pid") % 17)).alias("longitude"))
    return cleaning.valid_coords(p).select("pid")


@query("dropped_points", "B3 D6", f"""SELECT count(*) AS rows_before, count(*) FILTER (NOT listed) AS rows_after, {rd('count(*) FILTER (NOT listed)*100.0e0/count(*)')} AS kept FROM (
    SELECT (lat, lng) IN (SELECT (home_lat, home_lng) FROM home_points WHERE uid < 5) AS listed FROM stops)""")
def _(t: Tables):
    listed = t.home_points.where("uid < 5").select(F.col("home_lat").alias("lat"), F.col("home_lng").alias("lng"))
    return rounded(cleaning.kept_share(t.stops, cleaning.drop_points(t.stops, listed, ["lat", "lng"])), "kept")


@query("null_handling", "B5 B6", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.toxic IS NOT NULL AS complete FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t: Tables):
    df = t.read("documents").select("doc_id").join(t.read("labels"), "doc_id", "left")
    whole = df.dropna(subset=["quality", "toxic"]).select("doc_id", F.lit(True).alias("complete"))
    return df.fillna({"quality": -1}).join(whole, "doc_id", "left").fillna({"complete": False}).select("doc_id", "quality", "complete")


@query("finite_ratios", "B7", f"SELECT oid, line, pid, {rd('x/disc')} AS ratio FROM cases WHERE disc <> 0")
def _(t: Tables):
    ratio = F.when(F.col("disc") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("x"), F.col("disc")))
    return rounded(cleaning.drop_inf(t.cases.select("oid", "line", "pid", ratio.alias("ratio")), ["ratio"]), "ratio")


@query("first_event_per_person", "B8 B9", "SELECT DISTINCT ON (uid) uid, sid, loc, kind FROM stops ORDER BY uid, localtime, sid")
def _(t: Tables):
    return cleaning.first_per(t.stops, ["uid"], ["localtime", "sid"], ["sid", "loc", "kind"])


@query("complete_subjects", "B10", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t: Tables):
    o = t.read("orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return cleaning.complete_subjects(o, "o_custkey", ["status"]).select("o_orderkey")


@query("group_labels", "B11 B12 B18", """SELECT uid, CASE WHEN ice > 0.45e0 THEN 'D' WHEN ice < 0.35e0 THEN 'F' ELSE 'N' END AS grp_r, CASE WHEN low <= 0.2e0 THEN 'High income' WHEN low > 0.3e0 THEN 'Low income' ELSE 'Middle income' END AS income,
    CASE WHEN low <= 0.2e0 THEN 1 ELSE 0 END AS high FROM (SELECT uid, (birth_se-birth_other)*1.0e0/pop AS ice, q1*1.0e0/pop AS low FROM homes JOIN zones USING (deso))""")
def _(t: Tables):
    z = t.homes.join(t.zones, "deso")
    ice = indices.ice(F.col("birth_se"), F.col("birth_other"), F.col("pop"))
    out = z.select("uid", labels.group_r(ice, 0.35, 0.45).alias("grp_r"), labels.income_label(F.col("q1") / F.col("pop"), 0.2, 0.3).alias("income"))
    return cleaning.one_hot(out, "income", ["High income"]).withColumnRenamed("income_High income", "high")


PT = "CASE tag " + " ".join(f"WHEN '{tag}' THEN '{poi_types.POI_TYPES[tag]}'" for tag in TAGS.values()) + " END"
PT7 = "CASE tag " + " ".join(f"WHEN '{tag}' THEN '{poi_types.merged_types()[tag]}'" for tag in TAGS.values()) + " END"


@query("place_types", "B17", f"SELECT osm_id, {PT} AS poi_type, {PT7} AS poi_type7 FROM pois")
def _(t: Tables):
    out = cleaning.map_values(t.pois, "tag", poi_types.POI_TYPES, "poi_type")
    return cleaning.map_values(out, "tag", poi_types.merged_types(), "poi_type7").select("osm_id", "poi_type", "poi_type7")


@query("people_by_stay_count", "B25", "SELECT sid FROM stops JOIN (SELECT uid FROM stops GROUP BY 1 HAVING count(*) BETWEEN 50 AND 65) USING (uid)")
def _(t: Tables):
    return cleaning.having_size(t.stops, "uid", 50, 65).select("sid")


CODE = "concat(lpad(CAST(deso AS VARCHAR), 4, '0'), CASE deso%3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, lpad(CAST(pop AS VARCHAR), 4, '0'))"


@query("region_codes", "C1 B1", f"""SELECT code, substr(code, 1, 2) AS county, substr(code, 1, 4) AS municipality, CASE substr(code, 5, 1) WHEN 'C' THEN 'Urban' WHEN 'B' THEN 'Suburban' ELSE 'Rural/Suburban' END AS urban FROM (SELECT {CODE} AS code FROM zones)""")
def _(t: Tables):
    kind = F.when(F.col("deso") % 3 == 0, "A").when(F.col("deso") % 3 == 1, "B").otherwise("C")
    code = F.concat(F.lpad(F.col("deso").cast("string"), 4, "0"), kind, F.lpad(F.col("pop").cast("string"), 4, "0"))
    return cleaning.recode_zone(t.zones.select(code.alias("code")), "code")


@query("spans_from_text", "C4", "SELECT uid, time_seq, count(*) AS n FROM bins GROUP BY 1, 2")
def _(t: Tables):
    span = stay_span(F.col("h_s"), F.col("dur"))
    written = F.concat(F.lit("{"), F.array_join(F.flatten(F.transform(span, lambda s: F.array(s["lo"], s["hi"]))), ","), F.lit("}"))
    back = t.stops.select("uid", written.alias("s")).select("uid", F.explode(span_bins(text.parse_span(F.col("s")))).alias("time_seq"))
    return back.groupBy("uid", "time_seq").agg(F.count(F.lit(1)).alias("n"))


@query("counters_from_text", "C5", "SELECT uid, concat('z', deso) AS zone, count(*) AS n FROM stops GROUP BY 1, 2")
def _(t: Tables):
    counts = t.stops.groupBy("uid", F.concat(F.lit("z"), "deso").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat(F.lit("'"), "zone", F.lit("': "), "n")
    written = counts.groupBy("uid").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ", "), F.lit("}")).alias("s"))
    return written.select("uid", F.explode(text.expand_counter(F.col("s"))).alias("zone")).groupBy("uid", "zone").agg(F.count(F.lit(1)).alias("n"))


@query("enriched_visits", "D2", "SELECT s.sid, h.deso AS home_deso, z.pop, a.cum_jobs FROM stops s LEFT JOIN homes h USING (uid) LEFT JOIN zones z ON z.deso = h.deso LEFT JOIN access a ON a.deso = h.deso")
def _(t: Tables):
    out = features.enrich_visits(t.stops.select("sid", "uid"), t.homes.select("uid", "deso"), t.zones.select("deso", "pop"), t.access.select("deso", "cum_jobs"), "deso")
    return out.select("sid", F.col("deso").alias("home_deso"), "pop", "cum_jobs")


@query("outer_merged_measures", "D3 D4", """SELECT cell, coalesce(a.n, 0) AS suppliers, coalesce(b.n, 0) AS customers FROM (SELECT 10 + s_suppkey % 40 AS cell, count(*) AS n FROM supplier GROUP BY 1) a
    FULL JOIN (SELECT c_custkey % 40 AS cell, count(*) AS n FROM customer GROUP BY 1) b USING (cell)""")
def _(t: Tables):
    a = t.read("supplier").groupBy((10 + F.col("s_suppkey") % 40).alias("cell")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = t.read("customer").groupBy((F.col("c_custkey") % 40).alias("cell")).agg(F.count(F.lit(1)).alias("customers"))
    return features.align([a, b], "cell").fillna(0)


@query("backfilled_balance", "D14", f"SELECT c_custkey, {rd('coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, m)')} AS bal FROM customer LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS m FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def _(t: Tables):
    c = t.read("customer").select("c_custkey", F.col("c_nationkey").alias("deso"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))
    coarse = t.read("supplier").groupBy(F.col("s_nationkey").alias("deso")).agg(F.avg("s_acctbal").alias("bal"))
    return rounded(features.backfill(c, coarse, "deso", ["bal"]).select("c_custkey", "bal"), "bal")


# exposure at three resolutions of place: every place, zones of four places, counties of twenty
LEVELS = {"place": 1, "zone": 4, "county": 20}


def _grid_ctes() -> dict[str, str]:
    out = {}
    for name, size in LEVELS.items():
        out[f"exp_{name}"] = f"""SELECT e.weekday, e.holiday, e.time_seq, p.deso, e.ice, p.wt_p AS wt_total FROM (
            SELECT uid, weekday, holiday, time_seq, median((loc//{size}*37%100)/50.0e0 - 1) AS ice FROM bins GROUP BY 1, 2, 3, 4) e JOIN weights p USING (uid)"""
        knots = KNOTS.format(a="ice").replace("FROM pb", f"FROM exp_{name}")
        out[f"day_{name}"] = f"""SELECT deso, weekday, holiday, {rd('median(n)')} AS ind_count_{name}, {rd('median(nw)')} AS ind_count_wt_{name}, {rd('median(m)')} AS ice_birth_{name}, count(*) AS time_seq_count_{name} FROM (
            SELECT weekday, holiday, deso, time_seq, max(CASE WHEN k2 IS NULL AND k <= tot/2 THEN x WHEN first AND k >= tot/2 THEN x WHEN k <= tot/2 AND k2 > tot/2 THEN x + (tot/2-k)/(k2-k)*(x2-x) END) AS m, count(*) AS n, any_value(tot) AS nw
            FROM (SELECT *, lead(x) OVER o AS x2, lead(k) OVER o AS k2, row_number() OVER o = 1 AS first FROM ({knots}) WINDOW o AS (PARTITION BY weekday, holiday, deso, time_seq ORDER BY x, w, k)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
    return out


@query("home_grid_features", "E34", "SELECT * FROM day_place LEFT JOIN day_zone USING (deso, weekday, holiday) LEFT JOIN day_county USING (deso, weekday, holiday)", **_grid_ctes())
def _(t: Tables):
    levels = {}
    for name, size in LEVELS.items():
        value = F.pmod(F.floor(F.col("loc") / size) * 37, F.lit(100)) / 50.0 - 1
        levels[name] = t.bins.groupBy("uid", "weekday", "holiday", "time_seq").agg(F.median(value).alias("ice_birth")).join(t.weights, "uid")
    out = features.grid_features(levels, "deso", "wt_p")
    return rounded(out, *[f"{c}_{name}" for name in LEVELS for c in ("ind_count", "ind_count_wt", "ice_birth")])


@query("long_and_wide", "E38", "SELECT deso, birth_se, birth_eu, birth_other, birth_se + birth_eu + birth_other AS total FROM zones")
def _(t: Tables):
    long = t.zones.unpivot(["deso"], ["birth_se", "birth_eu", "birth_other"], "region", "n")
    total = long.groupBy("deso").agg(F.sum("n").alias("total"))
    return long.groupBy("deso").pivot("region", ["birth_se", "birth_eu", "birth_other"]).agg(F.sum("n")).join(total, "deso")


@query("group_extremes", "W11", """SELECT kind, sid, side FROM (SELECT kind, sid, CASE WHEN lo <= 2 THEN 'low' ELSE 'high' END AS side, lo, hi FROM (SELECT kind, sid, row_number() OVER (PARTITION BY kind ORDER BY dur, sid) AS lo,
    row_number() OVER (PARTITION BY kind ORDER BY dur DESC, sid DESC) AS hi FROM stops)) WHERE lo <= 2 OR hi <= 2""")
def _(t: Tables):
    return cleaning.extremes(t.stops.select("kind", "sid", "dur"), ["kind"], ["dur", "sid"], 2).select("kind", "sid", "side")


@query("longest_stays", "S1 S2", "SELECT sid, uid, dur FROM stops ORDER BY dur DESC, sid LIMIT 20")
def _(t: Tables):
    return t.stops.select("sid", "uid", "dur").orderBy(F.desc("dur"), "sid").limit(20)


@query("sampled_people", "S3", "SELECT sid FROM stops WHERE uid IN (SELECT uid FROM homes ORDER BY uid*7919 % 10007, uid LIMIT 40)")
def _(t: Tables):
    return features.sample_people(t.stops, "uid", 40, F.col("uid") * 7919 % 10007).select("sid")


@query("seeded_buckets", "S4")
def _(t: Tables):
    return features.bucket(t.homes, "uid", 12, 7).groupBy("gp").agg(F.count(F.lit(1)).alias("people"))


@query("train_test_split", "S5")
def _(t: Tables):
    from copresence.operators import models
    parts = models.split(t.cases, ["oid", "line", "pid"], [0.7, 0.15, 0.15], 1)
    return residential.stack({n: p.agg(F.count(F.lit(1)).alias("n")) for n, p in zip(("train", "valid", "test"), parts)}, "part")


@query("stacked_profiles", "U1", """SELECT 'phone' AS activity, time_seq, count(*) AS n FROM bins GROUP BY 2 UNION ALL SELECT 'survey', CAST(least(dep//30 + 1, 48) AS INTEGER), count(*) FROM trips GROUP BY 2""")
def _(t: Tables):
    phone = t.bins.groupBy("time_seq").agg(F.count(F.lit(1)).alias("n"))
    trips = t.trips.groupBy(F.least(F.floor(F.col("dep") / 30) + 1, F.lit(48)).cast("int").alias("time_seq")).agg(F.count(F.lit(1)).alias("n"))
    return residential.stack({"phone": phone, "survey": trips}, "activity")


@query("inner_joined_homes", "D1", "SELECT s.sid, h.deso AS home FROM stops s JOIN homes h USING (uid)")
def _(t: Tables):
    return t.stops.select("sid", "uid").join(t.homes.select("uid", F.col("deso").alias("home")), "uid").select("sid", "home")


@query("semi_and_anti", "D5 D6", "SELECT sid, uid IN (SELECT uid FROM homes WHERE n_stops > 70) AS frequent FROM stops")
def _(t: Tables):
    keys = t.homes.where("n_stops > 70").select("uid")
    s = t.stops.select("sid", "uid")
    yes = s.join(keys, "uid", "left_semi").withColumn("frequent", F.lit(True))
    return yes.unionByName(s.join(keys, "uid", "left_anti").withColumn("frequent", F.lit(False))).select("sid", "frequent")


@query("simulated_or_original", "B24", "SELECT sid, CASE WHEN sid%3 = 0 THEN concat('o', loc) ELSE concat('s', loc) END AS unit FROM stops")
def _(t: Tables):
    sim = F.when(F.col("sid") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), "loc"))
    return t.stops.select("sid", cleaning.fallback(sim, F.concat(F.lit("o"), "loc")).alias("unit"))
