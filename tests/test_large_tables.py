"""Shapes that fail at size: exploded sides sent whole to the driver, ties decided by the order of a sum."""

from pyspark.sql import functions as F

from copresence.operators import components, nullmodel, spatial
from copresence.plans import flows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listed_sides_are_not_broadcast(spark):
    a = spark.createDataFrame([(1, 5.0, 5.0)], "a int, x double, y double")
    b = spark.createDataFrame([(7, 5.0, 8.0)], "b int, x double, y double")
    df = spatial.within(a, b, "a", "b", 0.0, 10.0)
    assert "BroadcastExchange" not in plan(df)
    assert [(r.a, r.b, r.d) for r in df.collect()] == [(1, 7, 3.0)]


def test_points_on_one_spot_count_each(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 3.0, 4.0), (4, 3.0, 4.0), (5, 0.0, 9.0), (6, 90.0, 90.0), (7, None, 1.0)]
    points = spark.createDataFrame(rows, "id int, x double, y double")
    got = {r.id: (r.n, r.total) for r in spatial.ring_sums(points, "id", 1.0, 5.0).collect()}
    assert got == {1: (2, 10.0), 2: (2, 10.0), 3: (2, 10.0), 4: (2, 10.0)}
    near = spatial.nearest_within(points.where("id = 1"), points.where("id > 1").withColumnRenamed("id", "osm_id"), 5.0).collect()
    assert [(r.osm_id, r.distance, r.candidates) for r in near] == [(2, 0.0, 3)]
    homes = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 1.0), (2, 3.0, 4.0)], "county int, x double, y double")
    cells = spatial.od_candidates(homes, points.withColumnRenamed("id", "cell_id"), 4.5)
    assert sorted((r.county, r.cell_id) for r in cells.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]


def test_spots_are_joined_once(spark):
    # 300 places on one spot and 300 on another are two rows of the pair join, not 90,000 pairs
    points = spark.range(600).select(F.col("id"), F.when(F.col("id") < 300, 0.0).otherwise(3.0).alias("x"), F.lit(0.0).alias("y"))
    got = spatial.ring_sums(points, "id", 1.0, 5.0).agg(F.count("*"), F.sum("n"), F.sum("total")).first()
    assert tuple(got) == (600, 180000, 540000.0)


def test_noise_of_a_sum_decides_no_home(spark, monkeypatch):
    found = spark.createDataFrame([(1, 1, 1.0, 600.0, 0), (1, 2, 12.0, 600.0, 0)], "uid int, loc int, h_s double, dur double, holiday int")
    zones = spark.createDataFrame([(0, 10)], "deso int, pop int")
    scores = spark.createDataFrame([(1, 1, 0.3, 50.0), (1, 2, 0.1 + 0.2, 50.0)], "uid int, loc int, home_freq double, home_share double")
    monkeypatch.setattr(flows.home, "home_scores", lambda tempo: scores)
    assert [r.home for r in flows.homes_from_stays(found, zones, F.lit(0), 1).collect()] == [1]


def test_persons_with_equal_rings_share_a_pool(spark):
    homes = [(p, p % 2 * 400.0, 0.0, "Shop", d) for p in range(40) for d in (1, 2)] + [(99, 0.0, 0.0, "Shop", 1)]
    wanted = spark.createDataFrame(homes, "uid int, x double, y double, tag string, d int")
    pois = spark.createDataFrame([(1, 900.0, 0.0, "Shop", 7), (2, 900.0, 0.0, "Shop", 7), (3, 2100.0, 0.0, "Shop", 8), (4, 2100.0, 0.0, "Craft", 8), (5, 900.0, 0.0, "Craft", 9)],
                                 "osm_id int, x double, y double, tag string, unit int")
    sets = nullmodel.decay_sets(wanted, ["uid", "tag"])
    pools = {(r.x, tuple(r.ds), r.unit): r.places for r in nullmodel.decay_pools(sets, pois, "unit", 1000.0, 2).collect()}
    assert pools == {(0.0, (1, 2), 7): 2, (0.0, (1, 2), 8): 1, (400.0, (1, 2), 8): 1, (0.0, (1,), 7): 2}
    got = {(r.uid, r.unit): r.places for r in nullmodel.decay_pool(wanted, pois, "unit", ["uid", "tag"], 1000.0, 2).collect()}
    assert got == {**{(p, 7): 2 for p in range(0, 40, 2)}, **{(p, 8): 1 for p in range(40)}, (99, 7): 2}


def test_sites_listed_25_times_are_not_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(components, "components", lambda nodes, edges, by: seen.append(plan(edges)) or nodes.withColumn("root", F.col("v")))
    points = spark.createDataFrame([(1, 1, 55.0, 12.0), (1, 2, 55.0001, 12.0)], "dev int, node int, lat double, lng double")
    components.link_within(points, ["dev"], "node", "lat", "lng", 30).collect()
    assert "SortMergeJoin" in seen[0]
