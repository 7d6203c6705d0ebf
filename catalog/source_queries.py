"""Sources and sinks: tables derived from the data, written to the shared folder and read back."""

from pyspark.sql import functions as F

from catalog.fixtures import Tables, rounded
from catalog.registry import query
from copresence.operators import graph
from copresence.session import scratch
from copresence.sources import io, schemas, transit

PING_ROWS = "SELECT timestamp, CAST(device_aid AS VARCHAR) AS device_aid, latitude, longitude FROM pings"


def raw_pings(t: Tables):
    return t.pings.select("timestamp", F.col("device_aid").cast("string").alias("device_aid"), "latitude", "longitude", F.lit("GPS").alias("location_method"))


COLS = ["timestamp", "device_aid", "latitude", "longitude"]


@query("tsv_pings", "A2 A6", PING_ROWS)
def _(t: Tables):
    path = scratch(t.spark, "tsv")
    io.write_tsv(raw_pings(t), path)
    return io.read_pings(t.spark, path, COLS)


@query("landing_day", "A1", PING_ROWS + " WHERE timestamp // 86400 = 19737")
def _(t: Tables):
    root = scratch(t.spark, "landing")
    io.write_landing(raw_pings(t), root)
    return io.read_landing(t.spark, root, 1, 15, COLS)


@query("raw_csv_skips_bad_lines", "A3", "SELECT c_custkey, c_acctbal FROM customer")
def _(t: Tables):
    path = scratch(t.spark, "raw")
    good = t.read("customer").select(F.concat_ws(",", "c_custkey", "c_acctbal").alias("value"))
    bad = t.read("nation").select(F.concat(F.col("n_name"), F.lit(",broken")).alias("value"))
    good.unionByName(bad).write.text(path)
    schema = "` c_custkey ` bigint, `c_acctbal ` double"
    return io.read_raw(t.spark, path, schema, header=False)


@query("latin1_csv", "A4", "SELECT c_custkey, concat('Å', c_mktsegment) AS segment FROM customer WHERE c_acctbal > 4500")
def _(t: Tables):
    path = scratch(t.spark, "latin")
    t.read("customer").select("c_custkey", F.concat(F.lit("Å"), "c_mktsegment").alias("segment"), "c_acctbal").write.option(
        "encoding", "ISO-8859-1").option("header", True).csv(path)
    return io.read_csv(t.spark, path, "c_custkey bigint, segment string, c_acctbal double").where("c_acctbal > 4500").drop("c_acctbal")


@query("partitioned_pings", "A5 A7", PING_ROWS)
def _(t: Tables):
    path = scratch(t.spark, "pings")
    io.write_pings(raw_pings(t), path, 4)
    return io.read_group(t.spark, [path], COLS)


@query("user_batches", "A8 S4", "SELECT uid, sid FROM stops")
def _(t: Tables):
    path = scratch(t.spark, "batches")
    io.write_batches(t.stops.select("uid", "sid"), path, 5)
    return io.read_group(t.spark, [path], ["uid", "sid"])


@query("saved_table_scan", "A9 A10 S2", "SELECT uid, loc, dur FROM stops WHERE dur < 100 AND weekday = 1 UNION ALL SELECT uid, loc, dur FROM stops WHERE dur < 100 AND weekday = 1 AND holiday = 1")
def _(t: Tables):
    path = scratch(t.spark, "table")
    name = "stops_" + path.rsplit("-", 1)[1]
    s = t.stops.select("uid", "loc", "dur", "weekday", "holiday")
    io.save(s, name, "replace", path)
    io.save(s.where("holiday = 1"), name, "append")
    return io.scan(t.spark, name, ["uid", "loc", "dur"], "dur < 100 and weekday = 1")


CORNERS = """SELECT n_nationkey AS deso, n_regionkey AS county, c AS corner, n_nationkey%5*2000.0e0 + CASE WHEN c IN (1, 2) THEN 2000 ELSE 0 END AS x,
    n_nationkey//5*2000.0e0 + CASE WHEN c >= 2 THEN 2000 ELSE 0 END AS y FROM nation, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS c)"""


@query("stored_zones", "A11", f"SELECT deso, corner, x, y FROM ({CORNERS})")
def _(t: Tables):
    path = scratch(t.spark, "zones")
    io.save_zones(t.squares, path)
    return io.read_zones(t.spark, path).select("deso", F.posexplode("ring").alias("corner", "p")).select("deso", "corner", "p.x", "p.y")


@query("geojson_zones", "A12", f"SELECT deso, county, corner, x, y FROM ({CORNERS})")
def _(t: Tables):
    path = scratch(t.spark, "geojson")
    io.write_features(t.squares, path)
    z = io.read_features(t.spark, path, "deso:int,county:int")
    return z.select("deso", "county", F.posexplode("ring").alias("corner", "p")).select("deso", "county", "corner", "p.x", "p.y")


def feed(t: Tables):
    """A transit feed from the order tables: suppliers as stops, orders as trips, parts as routes."""
    li = t.read("lineitem")
    return {
        "shapes": li.select(F.col("l_orderkey").cast("string").alias("shape_id"), F.col("l_quantity").alias("shape_pt_lat"),
                            F.col("l_tax").alias("shape_pt_lon"), F.col("l_linenumber").alias("shape_pt_sequence")),
        "stops": t.read("supplier").select(F.col("s_suppkey").cast("string").alias("stop_id"), F.col("s_name").alias("stop_name"),
                                           (F.col("s_suppkey") % 40).cast("double").alias("stop_lat"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("stop_lon")),
        "routes": t.read("part").select(F.col("p_partkey").cast("string").alias("route_id"), F.when(F.col("p_size") > 40, 1501).otherwise(F.col("p_size")).alias("route_type")),
        "trips": t.read("orders").select(F.col("o_custkey").cast("string").alias("route_id"), F.col("o_orderkey").cast("string").alias("trip_id"), F.col("o_orderkey").cast("string").alias("shape_id")),
        "stop_times": li.select(F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_suppkey").cast("string").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence")),
    }


@query("clean_transit_feed", "A13 E73", """WITH bad AS (SELECT DISTINCT l_orderkey AS trip FROM lineitem WHERE l_suppkey % 40 = 0)
    SELECT 'shapes' AS name, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) WHERE c > 1
    UNION ALL SELECT 'stops', count(*) FROM supplier WHERE s_suppkey % 40 <> 0 UNION ALL SELECT 'routes', count(*) FROM part WHERE p_size = 3 OR p_size > 40
    UNION ALL SELECT 'trips', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT trip FROM bad) UNION ALL SELECT 'stop_times', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT trip FROM bad)""")
def _(t: Tables):
    folder = scratch(t.spark, "gtfs")
    for name, df in feed(t).items():
        df.select(*[c.split()[0] for c in schemas.GTFS[name].split(", ")]).write.option("header", True).csv(f"{folder}/{name}.txt")
    clean = transit.clean_gtfs(io.read_gtfs(t.spark, folder))
    clean["routes"] = clean["routes"].where("route_type = 3")
    out = None
    for name, df in clean.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("result_files", "A14", "SELECT uid, deso, n_stops FROM homes UNION ALL SELECT uid, deso, n_stops FROM homes")
def _(t: Tables):
    a, b = scratch(t.spark, "csv"), scratch(t.spark, "parquet")
    io.write_result(t.homes, a, "csv")
    io.write_result(t.homes, b)
    back = t.spark.read.schema("uid bigint, n_stops bigint, deso int").option("header", True).csv(a)
    return back.select("uid", "deso", "n_stops").unionByName(t.spark.read.parquet(b).select("uid", "deso", "n_stops"))


@query("embedding_files", "A15", """SELECT node_id, node, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(v AS DOUBLE), 6)+0 AS v FROM (
    SELECT vec_id AS node_id, concat('n', vec_id) AS node, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""")
def _(t: Tables):
    path, names = scratch(t.spark, "vec"), scratch(t.spark, "names")
    e = t.read("embeddings").withColumnRenamed("vec_id", "node_id").withColumn("embedding", F.transform("embedding", lambda v: v.cast("double")))
    io.write_embeddings(e, path)
    e.select("node_id", F.concat(F.lit("n"), "node_id").alias("node")).write.option("header", True).csv(names)
    back = io.read_embeddings(t.spark, path, names)
    return rounded(back.select("node_id", "node", F.posexplode("embedding").alias("pos", "v")), "v")


@query("stored_graph", "A16", "SELECT DISTINCT uid, loc, CAST(dense_rank() OVER (ORDER BY loc) - 1 AS BIGINT) AS node_id FROM stops")
def _(t: Tables):
    path = scratch(t.spark, "graph")
    nodes = graph.dense_ids(t.stops.select("loc").distinct(), "loc", "node_id")
    io.save_graph(nodes, t.stops.select("uid", "loc").distinct(), path)
    nodes, edges = io.load_graph(t.spark, path)
    return edges.join(nodes, "loc").select("uid", "loc", "node_id")


@query("pooled_access", "E74 B8", "SELECT uid, deso, max(c_acctbal) AS cum_jobs FROM homes LEFT JOIN customer ON c_nationkey = deso GROUP BY 1, 2")
def _(t: Tables):
    root = scratch(t.spark, "access")
    rows = t.read("customer").select(F.col("c_nationkey").cast("string").alias("id"), F.col("c_acctbal").alias("accessibility"), (F.col("c_custkey") % 3).alias("part"))
    rows.write.partitionBy("part").option("header", True).csv(root)
    files = transit.read_access(t.spark, f"{root}/part=*")
    home = t.homes.select("uid", "deso").withColumn("cell", F.col("deso").cast("string"))
    return transit.person_access(files, home, "cell", "cum_jobs").select("uid", "deso", "cum_jobs")
