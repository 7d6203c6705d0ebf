"""Logical tables of the library derived from the given tables, once for Spark and once as SQL.

Only arithmetic is used, so both sides build identical rows. `sql(body)` puts in front of a query the common
table expressions it names.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copresence.functions import time_bins
from copresence.operators import home as home_ops, mobility, profiles
from copresence.session import prepare

HOLIDAY = ("2024-01-08", "2024-01-14")
# fixed values: half-open income edges on account balance, in natural order
INCOME_EDGES = (1750.0, 4500.0, 7250.0)
# fixed values: place tags by part type
TAGS = {
    "ECONOMY": "Food and Drink (a)",
    "LARGE": "Food and Drink (s)",
    "MEDIUM": "Office",
    "PROMO": "Craft",
    "SMALL": "Shop",
    "STANDARD": "Education (a)",
}
ATTRS = ["number_of_locations", "number_of_visits", "average_displacement", "radius_of_gyration",
         "median_distance_from_home", "not_native", "other", "lowest_income", "cum_jobs", "cum_stops",
         "car_ownership"]


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Six places; sums in the tens of thousands and more are compared at three, which is still ten digits or so."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


class Tables:
    """Lazily built inputs of the registered queries."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def stops(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        day = F.to_date("ts")
        return (
            self.read("events").withColumn("k", k)
            .select(
                F.col("event_id").alias("sid"), F.col("user_id").alias("uid"), F.col("k").alias("loc"),
                (F.col("k") * 7 % 100 * 100.0).alias("x"), (F.col("k") * 13 % 100 * 100.0).alias("y"),
                (55.5 + (F.col("k") * 7 % 100) * 0.1).alias("lat"), (11.5 + (F.col("k") * 13 % 100) * 0.1).alias("lng"),
                F.col("ts").alias("localtime"), day.alias("day"), F.col("value").alias("dur"),
                (F.hour("ts") + F.minute("ts") / 60).alias("h_s"),
                F.when(F.datediff(day, F.lit("2024-01-01").cast("date")) % 7 >= 5, 0).otherwise(1).alias("weekday"),
                F.when(day.between(*[F.lit(d).cast("date") for d in HOLIDAY]), 1).otherwise(0).alias("holiday"),
                (F.col("k") % 25).alias("deso"), F.col("event_type").alias("kind"),
            )
        )

    @cached_property
    def pings(self) -> DataFrame:
        return self.stops.select(
            F.unix_seconds(F.col("localtime").cast("timestamp")).alias("timestamp"), F.col("uid").alias("device_aid"),
            F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), "x", "y", F.col("sid").alias("pid"),
        )

    @cached_property
    def zones(self) -> DataFrame:
        def n(cond):
            return F.count(F.when(cond, 1))

        seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
        e1, e2, e3 = INCOME_EDGES
        return self.read("customer").groupBy(F.col("c_nationkey").alias("deso")).agg(
            F.count(F.lit(1)).alias("pop"),
            n(seg.isin("AUTOMOBILE", "BUILDING", "FURNITURE")).alias("birth_se"),
            n(seg == "MACHINERY").alias("birth_eu"), n(seg == "HOUSEHOLD").alias("birth_other"),
            n(bal <= e1).alias("q1"), n((bal > e1) & (bal <= e2)).alias("q2"),
            n((bal > e2) & (bal <= e3)).alias("q3"), n(bal > e3).alias("q4"),
        )

    @cached_property
    def homes(self) -> DataFrame:
        return self.stops.groupBy("uid").agg(F.count(F.lit(1)).alias("n_stops")).withColumn("deso", (F.col("uid") % 25).cast("int"))

    @cached_property
    def weights(self) -> DataFrame:
        """uid, deso, wt_p: untrimmed person weight."""
        devices = self.homes.groupBy("deso").agg(F.count(F.lit(1)).alias("devices"))
        per_zone = devices.join(self.zones, "deso").select("deso", (F.col("pop") / F.col("devices")).alias("wt_p"))
        return self.homes.select("uid", "deso").join(per_zone, "deso")

    @cached_property
    def home_points(self) -> DataFrame:
        k = F.col("uid") % 100
        return self.homes.select(
            "uid", (k * 7 % 100 * 100.0).alias("hx"), (k * 13 % 100 * 100.0).alias("hy"),
            (55.5 + (k * 7 % 100) * 0.1).alias("home_lat"), (11.5 + (k * 13 % 100) * 0.1).alias("home_lng"))

    @cached_property
    def visits(self) -> DataFrame:
        s = self.stops.withColumn("time_span", time_bins.stay_span(F.col("h_s"), F.col("dur")))
        s = profiles.record_weights(s, []).join(self.weights.select("uid", "wt_p"), "uid")
        return s.withColumn("wt_total", F.col("wt") * F.col("wt_p"))

    @cached_property
    def bins(self) -> DataFrame:
        return time_bins.explode_bins(self.visits)

    @cached_property
    def access(self) -> DataFrame:
        jobs = self.read("supplier").groupBy(F.col("s_nationkey").alias("deso")).agg(F.count(F.lit(1)).alias("cum_jobs"))
        cars = self.read("customer").where(F.col("c_acctbal") > 4500).groupBy(F.col("c_nationkey").alias("deso")).agg(
            F.count(F.lit(1)).alias("cars"))
        stops = self.read("part").groupBy((F.col("p_partkey") % 25).cast("int").alias("deso")).agg(F.sum("p_size").alias("cum_stops"))
        return (
            self.zones.select("deso", "pop").join(jobs, "deso", "left").join(cars, "deso", "left").join(stops, "deso", "left")
            .fillna(0).select("deso", "cum_jobs", "cum_stops", (F.col("cars") / F.col("pop")).alias("car_ownership"))
        )

    @cached_property
    def mobility(self) -> DataFrame:
        return mobility.mobility_metrics(self.stops, self.home_points, slot="day", order=["localtime", "sid"])

    @cached_property
    def persons(self) -> DataFrame:
        """One row per person with the eleven attributes and the home zone's counts."""
        z = self.zones
        zone_side = z.join(self.access, "deso").select(
            "*", (1 - F.col("birth_se") / F.col("pop")).alias("not_native"), (F.col("birth_other") / F.col("pop")).alias("other"),
            (F.col("q1") / F.col("pop")).alias("lowest_income"))
        return self.weights.join(self.mobility, "uid").join(zone_side, "deso").withColumnRenamed("deso", "home_deso")

    @cached_property
    def pois(self) -> DataFrame:
        tag = F.lit(None).cast("string")
        for kind, label in TAGS.items():
            tag = F.when(F.col("p_type") == kind, label).otherwise(tag)
        return self.read("part").select(
            F.col("p_partkey").alias("osm_id"), (F.col("p_partkey") * 37 % 10000).cast("double").alias("x"),
            (F.col("p_partkey") * 91 % 10000).cast("double").alias("y"), tag.alias("tag"))

    @cached_property
    def squares(self) -> DataFrame:
        """Zone polygons: 25 squares of 2 km on a 10 km field."""
        i = F.col("n_nationkey")
        x0, y0 = i % 5 * 2000.0, F.floor(i / 5) * 2000.0
        corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
        return self.read("nation").select(
            i.alias("deso"), F.col("n_regionkey").alias("county"),
            F.array(corner(0, 0), corner(2000, 0), corner(2000, 2000), corner(0, 2000)).alias("ring"))

    @cached_property
    def trips(self) -> DataFrame:
        """Survey trips: clock text, zones, purposes and weights."""
        li = self.read("lineitem").select(
            F.col("l_orderkey").alias("sub_id"), F.col("l_linenumber").alias("trip_id"),
            (F.col("l_suppkey") % 25).cast("int").alias("origin"), (F.col("l_partkey") % 25).cast("int").alias("desti"),
            F.col("l_quantity").alias("weight"), (F.col("l_partkey") % 5).cast("int").alias("purpose"),
            ((F.col("l_linenumber") * 180 + F.col("l_partkey") % 120) % 1440).cast("int").alias("dep"),
            (F.col("l_suppkey") % 90 + 5).cast("int").alias("travel"))
        days = self.read("orders").select(F.col("o_orderkey").alias("sub_id"), F.to_date("o_orderdate").alias("date"))
        return li.join(days, "sub_id")

    @cached_property
    def groups(self) -> DataFrame:
        """uid, wt_p and residential group from the raw index of the home zone."""
        from copresence.functions import indices, labels
        ice = indices.ice(F.col("birth_se"), F.col("birth_other"), F.col("pop"))
        z = self.zones.select("deso", ice.alias("ice_r"))
        return self.weights.join(z, "deso").withColumn("grp_r", labels.group_r(F.col("ice_r"), 0.35, 0.45))

    @cached_property
    def cases(self) -> DataFrame:
        """One row per line item: two measures, an integer weight and three categories."""
        price = F.col("l_extendedprice") / 1000
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("oid"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("pid"),
            F.col("l_returnflag").alias("grp"),
            F.col("l_linestatus").alias("status"), price.alias("x"), (price * (1 - F.col("l_discount"))).alias("y"),
            F.col("l_quantity").alias("w"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
            (F.col("l_suppkey") % 25).cast("int").alias("zone"), (F.col("l_partkey") % 2).cast("int").alias("g"))

    @cached_property
    def links(self) -> DataFrame:
        return self.bins.groupBy("uid", F.col("loc").alias("zone")).agg(F.sum("wt_total").alias("weight"))


HAV = ("(2*6371.0e0*asin(least(1.0e0, sqrt(pow(sin(radians({lat2}-{lat1})/2),2)"
       "+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lng2}-{lng1})/2),2)))))")


def hav(lng1, lat1, lng2, lat2) -> str:
    return HAV.format(lng1=lng1, lat1=lat1, lng2=lng2, lat2=lat2)


def rd(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0e0)"


def rd3(expr: str) -> str:
    return rd(expr, 3)


_TAG_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " END"
_X = "({k}*7%100)"
_Y = "({k}*13%100)"


def _xy(k: str, x: str, y: str, lat: str, lng: str) -> str:
    a, b = _X.format(k=k), _Y.format(k=k)
    return f"{a}*100.0e0 AS {x}, {b}*100.0e0 AS {y}, 55.5e0+{a}*0.1e0 AS {lat}, 11.5e0+{b}*0.1e0 AS {lng}"


CTES: dict[str, str] = {
    "stops": f"""SELECT event_id AS sid, user_id AS uid, k AS loc, {_xy('k', 'x', 'y', 'lat', 'lng')}, ts AS localtime,
        CAST(ts AS DATE) AS day, value AS dur, hour(ts) + minute(ts)/60.0e0 AS h_s,
        CASE WHEN datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 7 >= 5 THEN 0 ELSE 1 END AS weekday,
        CASE WHEN CAST(ts AS DATE) BETWEEN DATE '{HOLIDAY[0]}' AND DATE '{HOLIDAY[1]}' THEN 1 ELSE 0 END AS holiday,
        k % 25 AS deso, event_type AS kind
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "pings": """SELECT CAST(floor(epoch(localtime)) AS BIGINT) AS timestamp, uid AS device_aid, lat AS latitude, lng AS longitude,
        x, y, sid AS pid FROM stops""",
    "zones": """SELECT c_nationkey AS deso, count(*) AS pop,
        count(*) FILTER (c_mktsegment IN ('AUTOMOBILE','BUILDING','FURNITURE')) AS birth_se,
        count(*) FILTER (c_mktsegment = 'MACHINERY') AS birth_eu, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS birth_other,
        count(*) FILTER (c_acctbal <= 1750) AS q1, count(*) FILTER (c_acctbal > 1750 AND c_acctbal <= 4500) AS q2,
        count(*) FILTER (c_acctbal > 4500 AND c_acctbal <= 7250) AS q3, count(*) FILTER (c_acctbal > 7250) AS q4
        FROM customer GROUP BY 1""",
    "homes": "SELECT uid, count(*) AS n_stops, CAST(uid % 25 AS INTEGER) AS deso FROM stops GROUP BY uid",
    "weights": """SELECT h.uid, h.deso, z.pop*1.0e0/d.devices AS wt_p FROM homes h
        JOIN (SELECT deso, count(*) AS devices FROM homes GROUP BY 1) d USING (deso) JOIN zones z USING (deso)""",
    "home_points": f"SELECT uid, {_xy('(uid%100)', 'hx', 'hy', 'home_lat', 'home_lng')} FROM homes",
    "prange": """SELECT *, CAST(floor(h_s*60/30) AS INTEGER) AS plo,
        CAST(least(floor((h_s*60 + floor(dur))/30), 95) AS INTEGER) AS phi FROM stops""",
    "inverse": """SELECT b, max(c) OVER () * 1.0e0 / c AS inv FROM (
        SELECT b % 48 AS b, count(*) AS c FROM (SELECT unnest(range(plo, phi+1)) AS b FROM prange) GROUP BY 1)""",
    "wts": """SELECT p.sid, coalesce(sum(i.inv), 0.0e0) AS wt FROM (SELECT sid, unnest(range(plo, least(phi,47)+1)) AS b FROM prange) p
        JOIN inverse i USING (b) GROUP BY 1""",
    "spans": """SELECT *, greatest(1, CAST(ceil(h_s*48/24) AS INTEGER)) AS lo,
        greatest(1, CAST(ceil(least(h_s+dur/60, 24.0e0)*48/24) AS INTEGER)) AS hi,
        CASE WHEN h_s+dur/60 > 24 THEN greatest(1, CAST(ceil((h_s+dur/60-24)*48/24) AS INTEGER)) END AS whi FROM stops""",
    "visits": """SELECT s.*, w.wt, p.wt_p, w.wt*p.wt_p AS wt_total FROM spans s JOIN wts w USING (sid)
        JOIN weights p ON s.uid = p.uid""",
    "bins": """SELECT * FROM (SELECT v.*, unnest(CASE WHEN whi IS NULL THEN range(lo, hi+1)
        ELSE list_concat(range(1, whi+1), range(lo, hi+1)) END) AS seq_big FROM visits v)
        SELECT_SEQ""",
    "access": """SELECT z.deso, coalesce(j.n, 0) AS cum_jobs, coalesce(s.n, 0) AS cum_stops, coalesce(c.n, 0)*1.0e0/z.pop AS car_ownership
        FROM zones z LEFT JOIN (SELECT s_nationkey AS deso, count(*) AS n FROM supplier GROUP BY 1) j USING (deso)
        LEFT JOIN (SELECT c_nationkey AS deso, count(*) AS n FROM customer WHERE c_acctbal > 4500 GROUP BY 1) c USING (deso)
        LEFT JOIN (SELECT CAST(p_partkey%25 AS INTEGER) AS deso, CAST(sum(p_size) AS BIGINT) AS n FROM part GROUP BY 1) s USING (deso)""",
    "mobility": f"""SELECT a.uid, number_of_locations, number_of_visits, path/nullif(number_of_visits-1, 0) AS average_displacement,
        rg AS radius_of_gyration, md AS median_distance_from_home FROM
        (SELECT uid, count(DISTINCT (lat, lng)) AS number_of_locations, count(*) AS number_of_visits, avg(lat) AS clat, avg(lng) AS clng
         FROM stops GROUP BY uid) a
        JOIN (SELECT uid, sum(d) AS path FROM (SELECT uid, {hav('lag(lng) OVER w', 'lag(lat) OVER w', 'lng', 'lat')} AS d FROM stops
              WINDOW w AS (PARTITION BY uid ORDER BY localtime, sid)) GROUP BY uid) b USING (uid)
        JOIN (SELECT s.uid, sqrt(avg(pow({hav('c.clng', 'c.clat', 's.lng', 's.lat')}, 2))) AS rg FROM stops s
              JOIN (SELECT uid, avg(lat) AS clat, avg(lng) AS clng FROM stops GROUP BY uid) c USING (uid) GROUP BY s.uid) g USING (uid)
        JOIN (SELECT s.uid, median({hav('h.home_lng', 'h.home_lat', 's.lng', 's.lat')}) AS md FROM stops s JOIN home_points h USING (uid)
              GROUP BY s.uid) m USING (uid)""",
    "persons": """SELECT w.uid, w.wt_p, w.deso AS home_deso, m.* EXCLUDE (uid), z.* EXCLUDE (deso), a.* EXCLUDE (deso),
        1 - z.birth_se*1.0e0/z.pop AS not_native, z.birth_other*1.0e0/z.pop AS other, z.q1*1.0e0/z.pop AS lowest_income
        FROM weights w JOIN mobility m ON w.uid = m.uid JOIN zones z ON z.deso = w.deso JOIN access a ON a.deso = w.deso""",
    "pois": f"""SELECT p_partkey AS osm_id, CAST(p_partkey*37%10000 AS DOUBLE) AS x, CAST(p_partkey*91%10000 AS DOUBLE) AS y,
        {_TAG_CASE} AS tag FROM part""",
    "trips": """SELECT l_orderkey AS sub_id, l_linenumber AS trip_id, CAST(l_suppkey%25 AS INTEGER) AS origin,
        CAST(l_partkey%25 AS INTEGER) AS desti, l_quantity AS weight, CAST(l_partkey%5 AS INTEGER) AS purpose,
        CAST((l_linenumber*180 + l_partkey%120)%1440 AS INTEGER) AS dep, CAST(l_suppkey%90+5 AS INTEGER) AS travel,
        CAST(o_orderdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "groups": """SELECT *, CASE WHEN ice_r > 0.45e0 THEN 'D' WHEN ice_r < 0.35e0 THEN 'F' ELSE 'N' END AS grp_r FROM (
        SELECT w.uid, w.deso, w.wt_p, (z.birth_se - z.birth_other)*1.0e0/z.pop AS ice_r FROM weights w JOIN zones z USING (deso))""",
    "cases": """SELECT l_orderkey AS oid, l_linenumber AS line, l_partkey AS pid, l_returnflag AS grp, l_linestatus AS status,
        l_extendedprice/1000 AS x, l_extendedprice/1000*(1-l_discount) AS y, l_quantity AS w, l_discount AS disc, l_tax AS tax,
        CAST(l_suppkey%25 AS INTEGER) AS zone, CAST(l_partkey%2 AS INTEGER) AS g FROM lineitem""",
    "links": "SELECT uid, loc AS zone, sum(wt_total) AS weight FROM bins GROUP BY 1, 2",
}
CTES["bins"] = """SELECT * EXCLUDE (b64), CAST(b64 AS INTEGER) AS time_seq FROM (SELECT v.*, unnest(CASE WHEN whi IS NULL
        THEN range(lo, hi+1) ELSE list_concat(range(1, whi+1), range(lo, hi+1)) END) AS b64 FROM visits v)"""


def sql(body: str, **extra: str) -> str:
    """Prefix a query with the common table expressions it uses, directly or through others."""
    known = {**CTES, **extra}
    wanted: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name, query in known.items():
            if name not in seen and re.search(rf"(\bFROM|\bJOIN|,)\s+\(*{name}\b", text):
                seen.add(name)
                need(query)
                wanted.append(name)

    need(body)
    if not wanted:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in wanted) + "\n" + body
