"""Survey trips, graph projection, embeddings and models."""

from pyspark.sql import Window, functions as F

from catalog.fixtures import ATTRS, Tables, r6, rd, rd3, rounded
from catalog.null_queries import arith_sql, arithmetic
from catalog.place_queries import SHARES, ice_sql, shares
from catalog.registry import query
from copresence.operators import embeddings, graph, models, nullmodel, survey

TRIPTIME = """SELECT *, CAST(date AS TIMESTAMP) + to_minutes(CAST(dep AS BIGINT)) AS dep_t, CAST(date AS TIMESTAMP) + to_minutes(CAST(dep AS BIGINT)) + to_minutes(CAST(travel AS BIGINT)) AS arr_t FROM trips"""


def timed_trips(t: Tables):
    """Trips with clock text read back into timestamps; arrivals past midnight roll over."""
    clock = lambda m: (F.floor(m / 60) * 100 + m % 60).cast("int")
    arr = (F.col("dep") + F.col("travel")) % 1440
    raw = t.trips.withColumns({"dep_c": clock(F.col("dep")).cast("string"), "arr_c": clock(arr).cast("string")})
    at = raw.withColumns({"dep": survey.parse_clock(F.col("date"), F.col("dep_c")), "arr": survey.parse_clock(F.col("date"), F.col("arr_c"))})
    return survey.travel_minutes(at, "dep", "arr").drop("dep_c", "arr_c")


@query("trip_times", "C2 C11", "SELECT travel, hour(arr_t) AS arr_hour, count(*) AS n, round(sum(epoch(arr_t) - epoch(dep_t))/60, 6)+0 AS minutes FROM trip_t GROUP BY 1, 2", trip_t=TRIPTIME)
def _(t: Tables):
    return timed_trips(t).groupBy("travel", F.hour("arr").cast("long").alias("arr_hour")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("travel_time")).alias("minutes"))


ORDER = "dep, trip_id, weight, desti, origin, travel"
FEAT = f"""SELECT sub_id, CASE WHEN first(origin ORDER BY {ORDER}) = last(desti ORDER BY {ORDER}) THEN 1 ELSE 0 END AS same_zone,
    CASE WHEN last(purpose ORDER BY {ORDER}) = 2 THEN 1 ELSE 0 END AS comm_end, CASE WHEN any_value(ll) > 1 THEN 1 ELSE 0 END AS round_end,
    CASE WHEN first(purpose ORDER BY {ORDER}) = last(purpose ORDER BY {ORDER}) THEN 1 ELSE 0 END AS same_pur
    FROM trips JOIN (SELECT sub_id, arg_max(c, trip_id) AS ll FROM (SELECT sub_id, trip_id, count(*) AS c FROM trips GROUP BY 1, 2) GROUP BY 1) USING (sub_id) GROUP BY 1"""
TORDER = ["dep", "trip_id", "weight", "desti", "origin", "travel"]


@query("trip_chain_features", "W8", "SELECT * FROM feat", feat=FEAT)
def _(t: Tables):
    return survey.chain_features(t.trips, TORDER)


@query("selected_participants", "W8 D5", "SELECT sub_id FROM feat WHERE same_zone = 1 AND comm_end + round_end + same_pur > 0", feat=FEAT)
def _(t: Tables):
    return survey.selected_participants(survey.chain_features(t.trips, TORDER)).select("sub_id")


ACTS = """SELECT t.sub_id, arr_t AS a0, coalesce(lead(dep_t) OVER w, t1) AS a1, CASE WHEN lead(dep_t) OVER w IS NULL THEN 0 ELSE purpose END AS purpose, desti AS zone FROM
    trip_t t JOIN bounds USING (sub_id) WINDOW w AS (PARTITION BY sub_id ORDER BY dep, trip_id, weight, desti, origin, travel)
    UNION ALL SELECT sub_id, t0, d0, 0, o0 FROM bounds"""
BOUNDS = f"""SELECT sub_id, o0, d0, CASE WHEN date = ld THEN CAST(date AS TIMESTAMP) ELSE CAST(ld AS TIMESTAMP) - INTERVAL 1 DAY END AS t0,
    CASE WHEN date = ld THEN CAST(ld AS TIMESTAMP) + INTERVAL 1 DAY ELSE CAST(ld AS TIMESTAMP) END AS t1 FROM (SELECT sub_id, any_value(date) AS date, first(origin ORDER BY {ORDER}) AS o0,
    first(dep_t ORDER BY {ORDER}) AS d0, CAST(last(arr_t ORDER BY {ORDER}) AS DATE) AS ld FROM trip_t GROUP BY 1)"""


@query("trip_activities", "W9 K4", f"""SELECT sub_id, purpose, zone, CASE purpose WHEN 0 THEN 'Home' WHEN 2 THEN 'Work' WHEN 3 THEN 'School' ELSE 'Other' END AS activity,
    (epoch(a1)-epoch(a0))/60.0e0 AS dur, CAST(hour(a0)*60+minute(a0) AS INTEGER) AS h_s FROM (SELECT *, bool_or(a1 <= a0) OVER (PARTITION BY sub_id) AS bad FROM acts) WHERE NOT coalesce(bad, false)""",
       trip_t=TRIPTIME, bounds=BOUNDS, acts=ACTS)
def _(t: Tables):
    trips = timed_trips(t).withColumn("slot", F.to_date("dep"))
    out = survey.trips_to_activities(trips, "slot", TORDER)
    return out.select("sub_id", "purpose", "zone", "activity", "dur", "h_s")


@query("od_matrices", "E5", f"""SELECT 'zone' AS level, origin AS o, desti AS d, {rd('sum(weight)')} AS weight FROM trips GROUP BY 2, 3
    UNION ALL SELECT 'county', origin%5, desti%5, {rd('sum(weight)')} FROM trips GROUP BY 2, 3
    UNION ALL SELECT 'commute', o, d, {rd('sum(w)')} FROM (SELECT sub_id, origin AS o, desti AS d, max(weight) AS w FROM trips WHERE purpose = 2 GROUP BY 1, 2, 3) GROUP BY 2, 3""")
def _(t: Tables):
    from copresence.operators.residential import stack
    o, d = F.col("origin"), F.col("desti")
    commute = t.trips.where("purpose = 2")
    parts = {"zone": survey.od_matrix(t.trips, o, d, "weight"), "county": survey.od_matrix(t.trips, o % 5, d % 5, "weight"),
             "commute": survey.od_matrix(commute, o, d, "weight", ["sub_id"])}
    return rounded(stack(parts, "level"), "weight")


# graphs

PAIRS = "SELECT a.uid, a.zone AS u, b.zone AS v, a.weight AS wu, b.weight AS wv FROM links a JOIN links b ON a.uid = b.uid AND a.zone < b.zone"


@query("place_projection", "J1", "SELECT u, v, count(*) AS visitors FROM pairs GROUP BY 1, 2", pairs=PAIRS)
def _(t: Tables):
    return graph.project(t.links)


@query("summed_projection", "J2", f"SELECT u, v, {rd3('sum(wu+wv)')} AS weight FROM pairs GROUP BY 1, 2", pairs=PAIRS)
def _(t: Tables):
    return rounded(graph.project_sum(t.links), "weight", digits=3)


def ice_edges(t: Tables):
    sa, sb = shares(t)
    people = t.homes.select("uid", "deso").join(t.zones, "deso").select("uid", "birth_se", "birth_other", "pop")
    return graph.project_ice(t.links.join(people, "uid"), sa, sb)


@query("index_projection", "J3", f"""SELECT u, v, {rd(f"coalesce({ice_sql('a', 'o', 'p', 'sa', 'sb')} + 2, 0)")} AS weight FROM (
    SELECT u, v, sum((wu+wv)*birth_se) AS a, sum((wu+wv)*birth_other) AS o, sum((wu+wv)*pop) AS p FROM pairs JOIN homes USING (uid) JOIN zones z USING (deso) GROUP BY 1, 2),
    (SELECT {SHARES[0]} AS sa, {SHARES[1]} AS sb)""", pairs=PAIRS)
def _(t: Tables):
    return rounded(ice_edges(t), "weight")


def place_edges(t: Tables):
    """Places joined by their common visitors, named by text."""
    name = lambda c: F.concat(F.lit("zone-"), F.col(c).cast("string")).alias(c)
    return graph.project_sum(t.links).select(name("u"), name("v"), "weight")


EDGES = "SELECT 'zone-' || a.zone AS u, 'zone-' || b.zone AS v, sum(a.weight+b.weight) AS weight FROM links a JOIN links b ON a.uid = b.uid AND a.zone < b.zone GROUP BY 1, 2"


@query("graph_nodes", "J4 A16", "SELECT node, row_number() OVER (ORDER BY node) - 1 AS node_id FROM (SELECT u AS node FROM edges UNION SELECT v FROM edges)", edges=EDGES)
def _(t: Tables):
    return graph.prune_index(place_edges(t))[1]


@query("graph_degrees", "J5", f"SELECT node, count(*) AS degree, {rd3('sum(weight)')} AS strength FROM (SELECT u AS node, weight FROM edges UNION ALL SELECT v, weight FROM edges) GROUP BY 1", edges=EDGES)
def _(t: Tables):
    return rounded(graph.degrees(place_edges(t)), "strength", digits=3)


@query("graph_counts", "J5", f"SELECT count(*) AS nodes, CAST(sum(c)/2 AS BIGINT) AS edges, {rd('avg(c)')} AS mean_degree FROM (SELECT node, count(*) AS c FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1)", edges=EDGES)
def _(t: Tables):
    return rounded(graph.graph_stats(place_edges(t)), "mean_degree")


@query("random_walks", "J6")
def _(t: Tables):
    return graph.walks(place_edges(t), n=10, length=20, p=0.5, q=2.0, seed=3)


@query("walk_pair_counts", "J7")
def _(t: Tables):
    return graph.pair_counts(graph.walks(place_edges(t), n=10, length=20, seed=3), 20)


# stored walks: the suppliers of an order, line by line
SKIP = dict(
    places="SELECT l_orderkey AS start, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS step, l_suppkey AS node FROM lineitem",
    nodeids="SELECT node, row_number() OVER (ORDER BY node) AS node_id FROM (SELECT DISTINCT node FROM places)",
    couples=f"""SELECT *, row_number() OVER (PARTITION BY start ORDER BY u, i, j) - 1 AS r, count(*) OVER (PARTITION BY start) AS p FROM (
        SELECT a.start, a.step AS i, b.step AS j, x.node_id AS target, y.node_id AS context, {arith_sql('a.start', 'a.step', 'b.step')} AS u FROM places a
        JOIN places b ON a.start = b.start AND a.step <> b.step AND abs(a.step - b.step) <= 3 JOIN nodeids x ON x.node = a.node JOIN nodeids y ON y.node = b.node)""",
    negative=f"""SELECT target, CAST(least(floor({arith_sql('start', 'r', 'k')}*n) + 1, n) AS BIGINT) AS context FROM (
        SELECT *, unnest(range(0, CAST(floor(p*1.5e0) AS BIGINT)//p + CASE WHEN r < CAST(floor(p*1.5e0) AS BIGINT) % p THEN 1 ELSE 0 END)) AS k FROM couples), (SELECT count(*) AS n FROM nodeids)""",
)


@query("skip_gram_examples", "J7", """SELECT least(target, context) AS target, greatest(target, context) AS context, label, count(*) AS weight FROM (
    SELECT target, context, 1 AS label FROM couples UNION ALL SELECT target, context, 0 FROM negative) WHERE target <> context GROUP BY 1, 2, 3""", **SKIP)
def _(t: Tables):
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]  # an order has few lines
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*line)) - 1
    walked = t.read("lineitem").select(F.col("l_orderkey").alias("start"), at.alias("step"), F.col("l_suppkey").alias("node"))
    ids = graph.dense_ids(walked.select("node").distinct(), "node", "node_id").withColumn("node_id", F.col("node_id") + 1)
    return graph.skip_gram_examples(walked, ids, 3, 1.5, arithmetic, ("start",))


@query("walk_examples", "J6 J7")
def _(t: Tables):
    edges = place_edges(t)
    ids = graph.prune_index(edges)[1].select("node", (F.col("node_id") + 1).alias("node_id"))
    return graph.skip_gram_examples(graph.walks(edges, n=10, length=20, seed=3), ids, 10, 4, nullmodel.hashed(5))


@query("node_vectors", "J7")
def _(t: Tables):
    return graph.embed(graph.walks(place_edges(t), n=10, length=20, seed=3), dim=64, window=20)


# embeddings

EMB = "SELECT vec_id, embedding, label, CASE WHEN label < 3 THEN 'D' WHEN label < 6 THEN 'F' ELSE 'N' END AS cls FROM embeddings"
FLAT = "SELECT vec_id, cls, label, unnest(range(1, 65)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM emb"


def emb(t: Tables):
    cls = F.when(F.col("label") < 3, "D").when(F.col("label") < 6, "F").otherwise("N")
    return t.read("embeddings").withColumn("cls", cls)


@query("class_axis", "J9 A15", f"SELECT CAST(pos-1 AS INTEGER) AS pos, {rd('avg(v) FILTER (cls=$$D$$) - avg(v) FILTER (cls=$$F$$)')} AS v FROM flat GROUP BY 1".replace("$$", "'"), emb=EMB, flat=FLAT)
def _(t: Tables):
    a = embeddings.axis(emb(t), "cls", "D", "F")
    return rounded(a.select(F.posexplode("axis").alias("pos", "v")), "v")


@query("stratified_axis", "J9", f"""SELECT CAST(pos-1 AS INTEGER) AS pos, {rd('avg(d)')} AS v FROM (SELECT pos, vec_id%4 AS s, avg(v) FILTER (cls='D') - avg(v) FILTER (cls='F') AS d FROM flat GROUP BY 1, 2) GROUP BY 1""", emb=EMB, flat=FLAT)
def _(t: Tables):
    a = embeddings.axis(emb(t).withColumn("s", F.col("vec_id") % 4), "cls", "D", "F", within=["s"])
    return rounded(a.select(F.posexplode("axis").alias("pos", "v")), "v")


@query("class_mean_vectors", "J11", f"SELECT cls AS class, CAST(pos-1 AS INTEGER) AS pos, {rd('avg(v)')} AS v FROM flat GROUP BY 1, 2", emb=EMB, flat=FLAT)
def _(t: Tables):
    m = embeddings.class_means(emb(t).withColumn("c2", F.when(F.col("cls") != "N", F.col("cls"))), "c2", default="N")
    return rounded(m.select("class", F.posexplode("mean").alias("pos", "v")), "v")


@query("axis_projection", "J10", f"""SELECT f.vec_id, {rd('sum(f.v*a.v)/(sqrt(sum(f.v*f.v))*sqrt(sum(a.v*a.v)))')} AS df FROM flat f JOIN
    (SELECT pos, avg(v) FILTER (cls='D') - avg(v) FILTER (cls='F') AS v FROM flat GROUP BY 1) a USING (pos) GROUP BY 1""", emb=EMB, flat=FLAT)
def _(t: Tables):
    e = emb(t)
    return rounded(embeddings.project_on(e.select("vec_id", "embedding"), {"df": embeddings.axis(e, "cls", "D", "F")}), "df")


@query("class_projection", "J10 J11", f"""SELECT f.vec_id, a.cls AS class, {rd('sum(f.v*a.v)/(sqrt(sum(f.v*f.v))*sqrt(sum(a.v*a.v)))')} AS cosine FROM flat f JOIN
    (SELECT cls, pos, avg(v) AS v FROM flat GROUP BY 1, 2) a USING (pos) GROUP BY 1, 2""", emb=EMB, flat=FLAT)
def _(t: Tables):
    e = emb(t)
    return rounded(embeddings.project_on_classes(e, embeddings.class_means(e, "cls"), "vec_id"), "cosine")


@query("forest_cv_accuracy", "J18")
def _(t: Tables):
    return models.rf_cv(emb(t), "embedding", "cls")


# models

@query("group_regression", "J8", f"""SELECT grp, count(*) AS n, {rd('sum(w*(x-mx)*(y-my))/sum(w*pow(x-mx,2))')} AS slope, {rd('any_value(my)-sum(w*(x-mx)*(y-my))/sum(w*pow(x-mx,2))*any_value(mx)')} AS intercept,
    {rd('pow(sum(w*(x-mx)*(y-my)),2)/(sum(w*pow(x-mx,2))*sum(w*pow(y-my,2)))')} AS r2 FROM cases JOIN (SELECT grp, sum(x*w)/sum(w) AS mx, sum(y*w)/sum(w) AS my FROM cases GROUP BY 1) USING (grp) GROUP BY 1""")
def _(t: Tables):
    return rounded(models.group_regression(t.cases, ["grp"], "x", "y", "w"), "slope", "intercept", "r2")


@query("standardised_features", "J19", f"SELECT uid, {rd('(number_of_visits-avg(number_of_visits) OVER ())/stddev_samp(number_of_visits) OVER ()')} AS number_of_visits, {rd('(radius_of_gyration-avg(radius_of_gyration) OVER ())/stddev_samp(radius_of_gyration) OVER ()')} AS radius_of_gyration FROM mobility")
def _(t: Tables):
    out = models.standardise(t.mobility, ["number_of_visits", "radius_of_gyration"])
    return rounded(out.select("uid", "number_of_visits", "radius_of_gyration"), "number_of_visits", "radius_of_gyration")


FEATURES = ["number_of_locations", "number_of_visits", "average_displacement", "radius_of_gyration", "median_distance_from_home"]


def person_table(t: Tables):
    """Persons with attributes and the raw index of their home zone."""
    return t.persons.join(t.groups.select("uid", "ice_r", "grp_r"), "uid").dropna()


@query("person_model_table", "J20 D2", f"""SELECT p.uid, {', '.join(f'{rd("p." + a)} AS {a}' for a in ATTRS)}, {rd('g.ice_r')} AS ice_r, g.grp_r FROM persons p JOIN groups g ON g.uid = p.uid""")
def _(t: Tables):
    numbers = [F.col(a).cast("double").alias(a) for a in ATTRS]
    return rounded(person_table(t).select("uid", *numbers, "ice_r", "grp_r"), *ATTRS, "ice_r")


@query("boosted_baseline", "J14 S5")
def _(t: Tables):
    return models.gbt_baseline(t.cases, ["oid", "line", "pid"], ["disc", "tax", "w", "zone"], "x")[1]


@query("boosted_baseline_pca", "J15")
def _(t: Tables):
    return models.gbt_baseline(t.cases, ["oid", "line", "pid"], ["disc", "tax", "w", "zone"], "x", pca=3)[1]


@query("feature_regression", "J16 J19")
def _(t: Tables):
    return models.feature_regression(person_table(t), ["uid"], FEATURES, "ice_r")


@query("additive_effects", "J17")
def _(t: Tables):
    importance, effects = models.additive_model(t.cases, ["disc", "tax", "w"], "x", bins=4, pairs=1)
    return effects.join(importance, "feature")


@query("additive_effects_by_group", "J17")
def _(t: Tables):
    out = models.additive_by_group(t.cases, ["grp"], ["disc", "tax", "w", "zone"], "x", bins=8, pairs=3)
    return rounded(out, "share", "effect", "importance")


@query("additive_cells_by_group", "J17", f"""SELECT grp, bin, {rd('count(*)/any_value(whole)')} AS share FROM (SELECT grp, CASE WHEN w <= 10 THEN 0 WHEN w <= 25 THEN 1 ELSE 2 END AS bin FROM cases)
    JOIN (SELECT grp, count(*)*1.0e0 AS whole FROM cases GROUP BY 1) USING (grp) GROUP BY 1, 2""")
def _(t: Tables):
    banded = t.cases.withColumn("band", F.when(F.col("w") <= 10, 0).when(F.col("w") <= 25, 1).otherwise(2))
    out = models.additive_by_group(banded, ["grp"], ["band", "tax"], "x", bins=20, pairs=0).where("feature = 'band'")
    return rounded(out.select("grp", "bin", "share"), "share")


def scored(scores, labels):
    """The labels with the silhouette of every k beside them."""
    every = scores.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", F.round("silhouette", 6)))))).scalar()
    return labels.withColumn("silhouettes", F.to_json(every))


@query("place_clusters", "J12")
def _(t: Tables):
    table = models.place_type_table(t.stops, "loc", "kind", ["click", "error", "purchase", "signup", "view"])
    return scored(*models.cluster(table, "loc", ["click", "error", "purchase", "signup", "view"], list(range(2, 20)), pick=3))


@query("person_clusters", "J13")
def _(t: Tables):
    return scored(*models.cluster(person_table(t), "uid", FEATURES, list(range(2, 10)), w="wt_p", pick=7))
