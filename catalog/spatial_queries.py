"""Distances, projections and spatial joins."""

from pyspark.sql import functions as F

from catalog.fixtures import Tables, hav, r6, rd, rd3, rounded
from catalog.registry import query
from copresence.functions import distance
from copresence.operators import hull, spatial

ZONE_OF = "CAST(floor({x}/2000.0e0) + 5*floor({y}/2000.0e0) AS INTEGER)"


@query("home_distance_km", "C15", f"""SELECT sid, {rd(hav('home_lng', 'home_lat', 'lng', 'lat'))} AS km FROM stops JOIN home_points USING (uid)""")
def _(t: Tables):
    km = distance.haversine(F.col("home_lng"), F.col("home_lat"), F.col("lng"), F.col("lat"))
    return t.stops.join(t.home_points, "uid").select("sid", r6(km).alias("km"))


def mercator_sql(lon0: str, inv_f: float) -> tuple[str, str]:
    """Transverse Mercator by the conformal-latitude series, as SQL over lat and lng."""
    a, k0 = 6378137.0, 0.9996
    f = 1 / inv_f
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n * n / 4 + n ** 4 / 64)
    e = (f * (2 - f)) ** 0.5
    al = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240]
    s = "sin(radians(lat))"
    tt = f"sinh(atanh({s}) - {e!r}*atanh({e!r}*{s}))"
    lam = f"radians(lng-({lon0}))"
    xi, eta = f"atan2({tt}, cos({lam}))", f"atanh(sin({lam})/sqrt(1+pow({tt},2)))"
    num = lambda v: f"CAST({v!r} AS DOUBLE)"
    east = "+".join([eta] + [f"{num(c)}*cos({2*j}*{xi})*sinh({2*j}*{eta})" for j, c in enumerate(al, 1)])
    north = "+".join([xi] + [f"{num(c)}*sin({2*j}*{xi})*cosh({2*j}*{eta})" for j, c in enumerate(al, 1)])
    return f"500000.0e0+{num(k0*big_a)}*({east})", f"{num(k0*big_a)}*({north})"


_UTM = mercator_sql("(floor((lng+180)/6)+1)*6-183", 298.257223563)
_SWE = mercator_sql("15.0e0", 298.257222101)


@query("utm_coordinates", "C17 C18", f"""SELECT loc, round({_UTM[0]}, 3)+0 AS utm_x, round({_UTM[1]}, 3)+0 AS utm_y,
    round({_SWE[0]}, 3)+0 AS tm_x, round({_SWE[1]}, 3)+0 AS tm_y FROM (SELECT DISTINCT loc, lat, lng FROM stops)""")
def _(t: Tables):
    spots = t.stops.select("loc", "lat", "lng").distinct()
    ux, uy = distance.to_utm(F.col("lat"), F.col("lng"))
    sx, sy = distance.to_3006(F.col("lat"), F.col("lng"))
    return spots.select("loc", *[F.round(c, 3).alias(n) for c, n in ((ux, "utm_x"), (uy, "utm_y"), (sx, "tm_x"), (sy, "tm_y"))])


@query("zone_area_density", "C21", f"""SELECT deso, 4.0e0 AS area_km2, {rd('pop/4.0e0')} AS density FROM zones""")
def _(t: Tables):
    area = distance.polygon_area(F.col("ring")) / 1e6
    return t.squares.select("deso", area.alias("area_km2")).join(t.zones, "deso").select(
        "deso", "area_km2", r6(F.col("pop") / F.col("area_km2")).alias("density"))


CENTRE = "(CAST({z} AS INTEGER)%5*2000.0e0+1000.0e0)", "(CAST({z} AS INTEGER)//5*2000.0e0+1000.0e0)"


def _c(z):
    return CENTRE[0].format(z=z), CENTRE[1].format(z=z)


@query("od_centroid_distance", "C16", f"""SELECT origin, desti, trips,
    {rd(f"sqrt(pow({_c('origin')[0]}-{_c('desti')[0]},2)+pow({_c('origin')[1]}-{_c('desti')[1]},2))")} AS metres
    FROM (SELECT origin, desti, count(*) AS trips FROM trips GROUP BY 1, 2)""")
def _(t: Tables):
    ring = F.col("ring")
    mid = lambda v: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[v]) / F.size(ring)
    centres = t.squares.select("deso", mid("x").alias("cx"), mid("y").alias("cy"))
    flows = t.trips.groupBy("origin", "desti").agg(F.count(F.lit(1)).alias("trips"))
    o = centres.select(F.col("deso").alias("origin"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    d = centres.select(F.col("deso").alias("desti"), F.col("cx").alias("dx"), F.col("cy").alias("dy"))
    m = distance.planar(F.col("ox"), F.col("oy"), F.col("dx"), F.col("dy"))
    return flows.join(o, "origin").join(d, "desti").select("origin", "desti", "trips", r6(m).alias("metres"))


@query("places_in_zones", "F1 A11", f"SELECT osm_id, {ZONE_OF.format(x='x', y='y')} AS deso FROM pois")
def _(t: Tables):
    return spatial.pip_join(t.pois, t.squares, "x", "y", "deso", 1000.0).select("osm_id", "deso")


HEX = """SELECT osm_id, deso, res, CASE WHEN res = 999 THEN '0' ELSE concat(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr-rs ELSE rq END AS INTEGER), ':',
    CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq-rs ELSE rr END AS INTEGER), '@', res) END AS hex_id FROM (
    SELECT *, abs(rq-q) AS dq, abs(rr-r) AS dr, abs(rs-s) AS ds FROM (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(s, 0) AS rs FROM (
    SELECT *, -q-r AS s FROM (SELECT osm_id, deso, res, (x*sqrt(3.0e0)/3-y/3)/size AS q, y*(2/3.0e0)/size AS r FROM (
    SELECT *, 4000.0e0/pow(sqrt(7.0e0), res-6) AS size FROM (SELECT osm_id, x, y, deso, CASE deso%4 WHEN 0 THEN 999 WHEN 1 THEN 9 WHEN 2 THEN 8 ELSE 7 END AS res
    FROM (SELECT *, CAST(floor(x/2000.0e0) + 5*floor(y/2000.0e0) AS INTEGER) AS deso FROM pois))))))) """


def units(t: Tables):
    # zone areas spread over the size classes so that all branches are used
    km2 = F.element_at(F.array(*[F.lit(v) for v in (0.4, 3.0, 10.0, 50.0)]), F.col("deso") % 4 + 1)
    zones = t.squares.select("deso", spatial.unit_resolution(km2).alias("resolution"))
    inside = spatial.pip_join(t.pois, t.squares, "x", "y", "deso", 1000.0)
    return spatial.assign_unit(inside, zones, "deso")


@query("mixed_units", "F2 F3 F5", "SELECT osm_id, deso, hex_id, CASE WHEN hex_id = '0' THEN CAST(deso AS VARCHAR) ELSE hex_id END AS unit FROM hexed", hexed=HEX)
def _(t: Tables):
    from copresence.operators.place import unit_id
    return units(t).select("osm_id", "deso", "hex_id", unit_id(F.col("deso").cast("string"), F.col("hex_id")).alias("unit"))


@query("occupied_units", "F4", "SELECT deso, hex_id, count(*) AS n_points FROM hexed GROUP BY 1, 2", hexed=HEX)
def _(t: Tables):
    return spatial.make_units(units(t), "deso")


@query("units_per_zone", "E78", f"""SELECT deso, count(*) AS n_units, count(DISTINCT hex_id) AS n_distinct, {rd('median(area)')} AS median_area FROM (
    SELECT DISTINCT deso, hex_id, CASE WHEN res = 999 THEN 4.0e6 ELSE 1.5e0*sqrt(3.0e0)*pow(4000.0e0/pow(sqrt(7.0e0), res-6), 2) END AS area FROM hexed) GROUP BY 1""", hexed=HEX)
def _(t: Tables):
    made = spatial.make_units(units(t), "deso")
    size = 4000.0 / F.pow(F.sqrt(F.lit(7.0)), F.split_part("hex_id", F.lit("@"), F.lit(2)).try_cast("int") - 6)
    area = F.when(F.col("hex_id") == "0", 4e6).otherwise(1.5 * F.sqrt(F.lit(3.0)) * size * size)
    return rounded(spatial.unit_stats(made.withColumn("area", area), "deso"), "median_area")


@query("small_in_large_squares", "F6", """SELECT osm_id, floor(x/1000.0e0)*1000.0e0 AS large_x, floor(y/1000.0e0)*1000.0e0 AS large_y FROM pois""")
def _(t: Tables):
    out = spatial.overlap_cells(t.pois, "x", "y", 1000.0).select("osm_id", "large_x", "large_y")
    return out.withColumns({c: F.col(c).cast("double") for c in ("large_x", "large_y")})


@query("ground_space_index", "F7", f"""SELECT deso, {rd('sum(w*h)/4e6')} AS gsi FROM (
    SELECT z.n_nationkey AS deso, greatest(0, least(p.x+p.s, zx+2000)-greatest(p.x, zx)) AS w, greatest(0, least(p.y+p.s, zy+2000)-greatest(p.y, zy)) AS h
    FROM (SELECT n_nationkey, n_nationkey%5*2000.0e0 AS zx, n_nationkey//5*2000.0e0 AS zy FROM nation) z,
    (SELECT x, y, p_size*1.0e0 AS s FROM pois JOIN part ON p_partkey = osm_id) p) GROUP BY 1""")
def _(t: Tables):
    side = F.col("p_size").cast("double")
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    zero = F.lit(0.0)
    houses = t.pois.join(t.read("part").select(F.col("p_partkey").alias("osm_id"), "p_size"), "osm_id").select(
        F.col("osm_id").alias("building_id"), F.array(at(zero, zero), at(side, zero), at(side, side), at(zero, side)).alias("ring"))
    return rounded(spatial.ground_space(houses, t.squares, "deso"), "gsi")


@query("places_per_km2", "F8", f"""SELECT z.deso, 4.0e0 AS area, {rd('count(p.osm_id)/4.0e0')} AS density FROM zones z LEFT JOIN
    (SELECT osm_id, {ZONE_OF.format(x='x', y='y')} AS deso FROM pois) p USING (deso) GROUP BY 1""")
def _(t: Tables):
    return rounded(spatial.zone_density(t.pois, t.squares, "deso"), "density")


EDGES = "SELECT x AS x1, y AS y1, x + p_size*5.0e0 AS x2, y + p_size*3.0e0 AS y2 FROM pois JOIN part ON p_partkey = osm_id"


@query("street_length_density", "F9", f"""SELECT z.deso, 4.0e0 AS area, {rd('coalesce(sum(len), 0)/4.0e0')} AS length_density FROM zones z LEFT JOIN
    (SELECT sqrt(pow(x1-x2,2)+pow(y1-y2,2)) AS len, (x1+x2)/2 AS mx, (y1+y2)/2 AS my FROM edges) e
    ON mx < 10000 AND my < 10000 AND z.deso = {ZONE_OF.format(x='mx', y='my')} GROUP BY 1""", edges=EDGES)
def _(t: Tables):
    size = F.col("p_size")
    edges = t.pois.join(t.read("part").select(F.col("p_partkey").alias("osm_id"), "p_size"), "osm_id").select(
        F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + size * 5.0).alias("x2"), (F.col("y") + size * 3.0).alias("y2"))
    return rounded(spatial.street_density(edges, t.squares, "deso"), "length_density")


@query("nearest_place", "F10", f"""SELECT x, y, arg_min(osm_id, d*1e7+osm_id) AS osm_id, {rd('min(d)')} AS distance, count(*) AS candidates FROM (
    SELECT s.x, s.y, p.osm_id, sqrt(pow(s.x-p.x,2)+pow(s.y-p.y,2)) AS d FROM (SELECT DISTINCT x, y FROM stops) s, pois p
    WHERE abs(s.x-p.x) <= 300 AND abs(s.y-p.y) <= 300) WHERE d <= 300 GROUP BY 1, 2""")
def _(t: Tables):
    return rounded(spatial.nearest_within(t.stops, t.pois, 300.0), "distance")


@query("places_in_ring", "F11", f"""SELECT a, count(*) AS n, {rd3('sum(d)')} AS total FROM (SELECT a.osm_id AS a, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS d
    FROM pois a JOIN pois b ON abs(a.x-b.x) <= 1000 AND abs(a.y-b.y) <= 1000) WHERE d > 30 AND d <= 1000 GROUP BY 1""")
def _(t: Tables):
    return rounded(spatial.ring_sums(t.pois.withColumnRenamed("osm_id", "a"), "a", 30.0, 1000.0), "total", digits=3)


@query("job_access", "F12", f"""SELECT uid, {rd('sum(v*(1-d/1500))')} AS access, CAST(sum(v) AS BIGINT) AS reached FROM (
    SELECT h.uid, p_size AS v, sqrt(pow(h.hx-p.x,2)+pow(h.hy-p.y,2)) AS d FROM home_points h, pois p JOIN part ON p_partkey = osm_id)
    WHERE d <= 1500 GROUP BY 1""")
def _(t: Tables):
    jobs = t.pois.join(t.read("part").select(F.col("p_partkey").alias("osm_id"), "p_size"), "osm_id")
    homes = t.home_points.select("uid", F.col("hx").alias("x"), F.col("hy").alias("y"))
    return rounded(spatial.access_within(homes, jobs, "uid", "p_size", 1500.0), "access")


# grid squares of two sizes, with jobs; hull edges by testing every pair of corners
GRID = """SELECT osm_id AS cell_id, x, y, CASE WHEN osm_id % 4 = 0 THEN 1000.0e0 ELSE 250.0e0 END AS size, greatest(p_size - 10, 0) AS job FROM pois JOIN part ON p_partkey = osm_id"""
CORNER = """SELECT DISTINCT n_regionkey AS county, size, 2000.0e0*(n_nationkey%5 + i) + j*size/2 AS vx, 2000.0e0*(n_nationkey//5 + k) + l*size/2 AS vy
    FROM nation, (SELECT unnest([250.0e0, 1000.0e0]) AS size), (SELECT unnest([0, 1]) AS i), (SELECT unnest([-1, 1]) AS j), (SELECT unnest([0, 1]) AS k), (SELECT unnest([-1, 1]) AS l)"""
EDGE = """SELECT a.county, a.size, a.vx AS ax, a.vy AS ay, b.vx - a.vx AS dx, b.vy - a.vy AS dy FROM corner a JOIN corner b ON a.county = b.county AND a.size = b.size AND (a.vx <> b.vx OR a.vy <> b.vy)
    WHERE NOT EXISTS (SELECT 1 FROM corner c WHERE c.county = a.county AND c.size = a.size AND (b.vx-a.vx)*(c.vy-a.vy) - (b.vy-a.vy)*(c.vx-a.vx) < 0)"""


def grid_squares(t: Tables):
    jobs = t.read("part").select(F.col("p_partkey").alias("osm_id"), F.greatest(F.col("p_size") - 10, F.lit(0)).alias("job"))
    return t.pois.join(jobs, "osm_id").select(F.col("osm_id").alias("cell_id"), "x", "y", F.when(F.col("osm_id") % 4 == 0, 1000.0).otherwise(250.0).alias("size"), "job")


@query("county_destinations", "F13", """SELECT county, cell_id, job FROM (SELECT e.county, g.cell_id, g.job, min(dx*(g.y-ay) - dy*(g.x-ax)) >= 0 AS inside,
    min(sqrt(pow(g.x-ax-dx*f, 2) + pow(g.y-ay-dy*f, 2))) AS away FROM (SELECT *, least(greatest(((g.x-ax)*dx + (g.y-ay)*dy)/(dx*dx + dy*dy), 0), 1) AS f FROM grid g JOIN edge USING (size) WHERE job > 0) e
    JOIN grid g USING (cell_id) GROUP BY 1, 2, 3) WHERE inside OR away <= 400""", grid=GRID, corner=CORNER, edge=EDGE)
def _(t: Tables):
    return hull.county_destinations(t.squares, grid_squares(t), 400.0, [250.0, 1000.0], cell=500.0).select("county", "cell_id", "job")


@query("county_origins", "F13", """SELECT min(n_regionkey) AS county, cell_id FROM (SELECT uid, 1 + uid % (SELECT count(*) FROM part) AS cell_id FROM homes) h JOIN nation ON n_nationkey = uid % 25
    JOIN pois ON osm_id = cell_id GROUP BY 2""")
def _(t: Tables):
    n = t.read("part").select(F.count(F.lit(1))).scalar()
    county = t.squares.select(F.col("deso"), "county")
    homes = t.homes.select("uid", (F.col("uid") % 25).cast("int").alias("deso")).join(county, "deso").withColumn("_n", n)
    return hull.county_origins(homes.withColumn("cell_id", 1 + F.col("uid") % F.col("_n")), grid_squares(t)).select("county", "cell_id")


@query("home_surroundings", "F11", """SELECT DISTINCT n.n_regionkey AS county, p.osm_id AS cell_id FROM home_points h
    JOIN nation n ON n.n_nationkey = h.uid % 25, pois p WHERE sqrt(pow(h.hx-p.x,2)+pow(h.hy-p.y,2)) <= 400""")
def _(t: Tables):
    county = t.squares.select(F.col("deso"), "county")
    homes = t.home_points.withColumn("deso", (F.col("uid") % 25).cast("int")).join(county, "deso").select(
        "county", F.col("hx").alias("x"), F.col("hy").alias("y"))
    grid = t.pois.select(F.col("osm_id").alias("cell_id"), "x", "y")
    return spatial.od_candidates(homes, grid, 400.0).select("county", "cell_id")
