import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from copresence.functions import distance, draws, indices, labels
from copresence.operators import (cleaning, compare, components, embeddings, experienced, graph, home, nullmodel, spatial, stays, survey)
from copresence.sources import io


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_indices(spark):
    lit = F.lit
    assert one(spark, indices.evenness([lit(1.0)] * 4)) == 0.0
    assert math.isclose(one(spark, indices.evenness([lit(4.0), lit(0.0), lit(0.0), lit(0.0)])), 1.0)
    assert one(spark, indices.ice(lit(5.0), lit(0.0), lit(5.0), lit(0.8), lit(0.1))) == 1.0
    assert one(spark, indices.ice(lit(0.0), lit(5.0), lit(5.0), lit(0.8), lit(0.1))) == -1.0
    assert math.isclose(one(spark, indices.ice(lit(8.0), lit(1.0), lit(10.0), lit(0.8), lit(0.1))), 0.0, abs_tol=1e-12)
    assert one(spark, indices.ice(lit(0.0), lit(0.0), lit(0.0), lit(0.8), lit(0.1))) is None
    assert math.isclose(one(spark, indices.signed_change(lit(-0.3), lit(-0.1))), -0.2)


def test_projection_against_known_point(spark):
    # Stockholm city hall area: 59.3293 N 18.0686 E is close to 674032 E, 6580822 N in the national grid
    e, n = distance.to_3006(F.lit(59.3293), F.lit(18.0686))
    assert abs(one(spark, e) - 674571) < 600 and abs(one(spark, n) - 6580743) < 600
    e, n = distance.to_utm(F.lit(0.0), F.lit(3.0))
    assert math.isclose(one(spark, e), 500000.0, abs_tol=1e-6) and abs(one(spark, n)) < 1e-6
    # on the central meridian the northing is the scaled meridian arc: a quarter meridian is 10001965.729 m
    _, n = distance.transverse_mercator(F.lit(89.9999999), F.lit(3.0), F.lit(3.0), k0=1.0)
    assert abs(one(spark, n) - 10001965.729) < 0.05


def test_polygon_tests(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]  # an L
    df = spark.createDataFrame([(x / 4 + 0.125, y / 4 + 0.125) for x in range(9) for y in range(9)], "x double, y double")
    poly = spark.createDataFrame([("L", ring)], "name string, ring array<struct<x:double,y:double>>")
    assert poly.select(distance.polygon_area(F.col("ring"))).first()[0] == 3.0
    got = {(r.x, r.y) for r in spatial.pip_join(df, poly, "x", "y", "name", 0.5).collect()}
    want = {(r.x, r.y) for r in df.collect() if (r.x < 2 and r.y < 1) or (r.x < 1 and r.y < 2)}
    assert got == want


def test_clip():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    assert spatial._clip(square + 1, square) == 1.0
    assert spatial._clip(np.array([[0, 0], [4, 0], [0, 4]], float), square) == 4.0
    assert spatial._clip(square + 5, square) == 0.0


def test_neighbours_match_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(60)]
    b = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(80)]
    got = {(r.a, r.b) for r in spatial.within(spark.createDataFrame(a, "a int, x double, y double"),
                                             spark.createDataFrame(b, "b int, x double, y double"), "a", "b", 2.0, 15.0).collect()}
    want = {(i, j) for i, x, y in a for j, p, q in b if 2 < math.dist((x, y), (p, q)) <= 15}
    assert got == want


def test_links_within_metres(spark):
    rng = random.Random(4)
    deg = 1 / 111195.0
    pts = [(d, i, 59.0 + rng.uniform(0, 400) * deg, 18.0 + rng.uniform(0, 400) * deg / math.cos(math.radians(59))) for d in ("a", "b") for i in range(70)]
    df = spark.createDataFrame(pts, "dev string, node long, lat double, lng double")
    got = {(r.dev, r.node): r.loc for r in components.link_within(df, ["dev"], "node", "lat", "lng", 30).collect()}

    def hav(p, q):
        la, lb = math.radians(p[2]), math.radians(q[2])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    for dev in ("a", "b"):
        mine = [p for p in pts if p[0] == dev]
        root = {p[1]: p[1] for p in mine}
        changed = True
        while changed:
            changed = False
            for p in mine:
                for q in mine:
                    if hav(p, q) <= 30 and root[p[1]] != root[q[1]]:
                        root[p[1]] = root[q[1]] = min(root[p[1]], root[q[1]])
                        changed = True
        order = {r: i + 1 for i, r in enumerate(sorted(set(root.values())))}
        assert {n: got[(dev, n)] for n in root} == {n: order[r] for n, r in root.items()}


def test_stops_of_a_simple_day(spark):
    home_pts = [("a", t, 59.0 + (t % 3) * 1e-5, 18.0) for t in range(0, 3600, 300)]
    trip = [("a", 3700, 59.01, 18.01), ("a", 3800, 59.02, 18.02)]
    work = [("a", t, 59.03, 18.03) for t in range(4000, 8000, 500)]
    back = [("a", t, 59.0, 18.0) for t in range(9000, 12000, 600)]
    df = spark.createDataFrame(home_pts + trip + work + back, "device_aid string, timestamp long, latitude double, longitude double")
    got = stays.stays_from_points(stays.detect_stops(df, ["timestamp"])).orderBy("start").collect()
    assert [(r.loc, r.start, r.end, r.size) for r in got] == [(1, 0, 3300, 12), (2, 4000, 7500, 8), (1, 9000, 11400, 5)]
    assert math.isclose(got[0].latitude, got[2].latitude)


def stops_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, "device_aid string, timestamp long, latitude double, longitude double")
    return [(r.device_aid, r.loc, r.start, r.end, r.size) for r in stays.stays_from_points(stays.detect_stops(df, ["timestamp"], **kw)).orderBy("device_aid", "start").collect()]


NORTH = 1 / 111_195  # degrees of a metre


def test_a_slow_walk_is_no_stay(spark):
    assert stops_of(spark, [("a", 10 * i, 59 + 14 * i * NORTH, 18.0) for i in range(120)]) == []


def test_jitter_is_one_stay(spark):
    rows = [("a", 60 * i, 59 + ((i * 7) % 11 - 5) * 4 * NORTH, 18.0) for i in range(60)]
    assert stops_of(spark, rows) == [("a", 1, 0, 3540, 60)]


def test_one_place_in_two_groups_is_one_stay(spark):
    """A jump of 35 m closes the group; a third group between the two links them to one place, and the stay goes on."""
    at = lambda start, metres: [("a", start + 60 * i, 59 + metres * NORTH, 18.0) for i in range(20)]
    rows = at(0, 0) + at(1200, 35) + at(2400, 0) + at(20_000, 17.5)
    assert stops_of(spark, rows) == [("a", 1, 0, 3540, 60), ("a", 1, 20_000, 21_140, 20)]
    assert stops_of(spark, at(0, 0) + at(1200, 35)) == [("a", 1, 0, 1140, 20), ("a", 2, 1200, 2340, 20)]


def test_stops_equal_a_sequential_pass(spark):
    """A hot device and small ones against the plain loop."""
    rng = np.random.default_rng(4)
    rows, want = [], []
    for dev, n in (("a", 1500), ("b", 40), ("c", 3)):
        lat, lng, t = 59.0, 18.0, 0
        trace = []
        for _ in range(n):
            step = rng.choice([0, 5, 25, 50, 500], p=[0.5, 0.3, 0.1, 0.07, 0.03])
            lat, lng, t = lat + rng.normal() * step * NORTH, lng + rng.normal() * step * 2 * NORTH, t + int(rng.choice([30, 120, 600, 12_000], p=[0.5, 0.3, 0.19, 0.01]))
            trace.append((dev, t, float(lat), float(lng)))
        rows += trace
        groups = []
        for p in trace:
            own = groups[-1] if groups else None
            if own and p[1] - own[-1][1] <= 10_800:
                la, ln = math.radians(np.mean([q[2] for q in own])), np.mean([q[3] for q in own])
                h = math.sin((math.radians(p[2]) - la) / 2) ** 2 + math.cos(la) * math.cos(math.radians(p[2])) * math.sin(math.radians(p[3] - ln) / 2) ** 2
                if 2 * 6_371_000 * math.asin(math.sqrt(h)) <= 30:
                    own.append(p)
                    continue
            groups.append([p])
        want += sorted(p for g in groups if len(g) >= 2 and g[-1][1] - g[0][1] >= 900 for p in g)
    df = spark.createDataFrame(rows, "device_aid string, timestamp long, latitude double, longitude double")
    got = sorted(tuple(r) for r in stays.detect_stops(df, ["timestamp"]).select("device_aid", "timestamp", "latitude", "longitude").collect())
    assert got == sorted(want) and len(got) > 100


def test_densify(spark):
    df = spark.createDataFrame([("a", 0), ("a", 100), ("a", 50000)], "device_aid string, timestamp long")
    got = sorted(r.timestamp for r in stays.densify(df, ["timestamp"], 10800).collect())
    assert got == [0, 100, 10899, 50000]


def test_device_weights_skip_empty_zones(spark):
    zones = spark.createDataFrame([("x", 100), ("y", 10), ("z", 10), ("empty", 50)], "deso string, pop int")
    homes = spark.createDataFrame([(i, "x" if i == 0 else "y" if i < 6 else "z") for i in range(11)], "uid int, deso string")
    got = {r.deso: r for r in home.device_weights(homes, zones).collect()}
    w = np.array([100.0, 2.0, 2.0])
    cut = 3.5 * np.median(w) * math.sqrt((w.std() / w.mean()) ** 2 + 1)
    assert set(got) == {"x", "y", "z"} and math.isclose(got["x"].wt_p, cut) and got["y"].wt_p == 2.0


def test_labels(spark):
    df = spark.createDataFrame([("Food and Drink (a)", "Food and Drink (s)"), ("Office", "Craft"), ("Shop", "Home (s)"), ("Office", "Shop"), ("Craft", "Craft")], "a string, b string")
    assert [r[0] for r in df.select(labels.tag_tier(F.col("a"), F.col("b"))).collect()] == [2, 3, 4, 0, 1]
    x = spark.createDataFrame([(0.0,), (0.5,), (0.51,), (1.0,), (1.1,)], "x double")
    assert [r[0] for r in x.select(labels.cut(F.col("x"), [0, 0.5, 1], ["lo", "hi"], True)).collect()] == ["lo", "lo", "hi", "hi", None]


def test_tag_classes_agree_with_tiers(spark):
    tags = ["Food and Drink (a)", "Food and Drink (s)", "Office", "Craft", "Shop", "Education (a)", "Office (s)", "Tourism"]
    df = spark.createDataFrame([(a, b) for a in tags for b in tags], "a string, b string")
    shared = F.array_intersect(nullmodel.tag_classes(F.col("a")), nullmodel.tag_classes(F.col("b")))
    low = F.coalesce(F.array_min(F.transform(shared, lambda e: e["tier"])), F.lit(0))
    assert df.where(low != labels.tag_tier(F.col("a"), F.col("b"))).count() == 0


def test_rank_test_equal_samples(spark):
    rows = [(float(v), g, 1.0) for v in range(20) for g in (0, 1)]
    r = compare.wrank_test(spark.createDataFrame(rows, "x double, g int, w double"), [], "x", "g", "w").first()
    assert math.isclose(r.estimate, 0.0, abs_tol=1e-12) and r.n == 40
    shifted = [(float(v + 100 * g), g, 1.0) for v in range(20) for g in (0, 1)]
    r = compare.wrank_test(spark.createDataFrame(shifted, "x double, g int, w double"), [], "x", "g", "w").first()
    assert math.isclose(r.estimate, 0.5)
    assert compare.wks(spark.createDataFrame(shifted, "x double, g int, w double"), [], "x", "g", "w").first().ks == 1.0


def test_bootstrap_is_stable_and_unbiased(spark):
    df = spark.createDataFrame([(i, float(i % 10), 1.0) for i in range(300)], "id int, x double, w double")
    a = compare.replicates(df, ["id"], 30, 1).groupBy().agg(F.sum("copies")).first()[0]
    b = compare.replicates(df.repartition(7), ["id"], 30, 1).groupBy().agg(F.sum("copies")).first()[0]
    assert a == b and abs(a / (300 * 30) - 1) < 0.05
    rate = compare.replicates(df, ["id"], 30, 1, F.lit(3.0)).groupBy().agg(F.sum("copies")).first()[0]
    assert abs(rate / (300 * 30 * 3) - 1) < 0.05
    big = compare.replicates(df, ["id"], 5, 1, F.lit(50.0)).groupBy().agg(F.sum("copies")).first()[0]
    assert abs(big / (300 * 5 * 50) - 1) < 0.05


def test_segregated_decision(spark):
    rows = [("in", i, (i % 21 - 10) / 100, 1.0) for i in range(200)] + [("out", i, 0.5 + (i % 21) / 100, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id int, x double, w double")
    assert {r.g: r.seg for r in compare.segregated(df, ["g"], "x", "w", n=100).collect()} == {"in": 0, "out": 1}


def test_draws_cover_the_pool_and_ignore_partitioning(spark):
    pool = spark.createDataFrame([("k", "a", 3), ("k", "b", 1)], "key string, unit string, places long")
    st = spark.createDataFrame([(i, "k" if i else "none", "here") for i in range(40)], "sid long, key string, unit string")
    run = lambda s: sorted((r.sid, r.sim, r.unit_s or "") for r in nullmodel.draw(s, pool, ["key"], "unit", ["sid"], 50, nullmodel.hashed(1)).collect())
    got = run(st)
    assert got == run(st.repartition(5, "sid"))
    hits = [u for i, _, u in got if i]
    assert abs(hits.count("a") / len(hits) - 0.75) < 0.05 and all(u == "" for i, _, u in got if i == 0)


def test_walks_follow_edges_and_bias(spark):
    edges = spark.createDataFrame([(0, i, 1.0 + i) for i in range(1, 6)] + [(1, 2, 2.0)], "u long, v long, weight double")
    for p, q in ((1.0, 1.0), (0.25, 4.0)):
        w = graph.walks(edges, n=40, length=4, p=p, q=q, seed=1).collect()
        paths = {}
        for r in w:
            paths.setdefault((r.start, r.walk), {})[r.step] = r.node
        pairs = {(r.u, r.v) for r in edges.collect()} | {(r.v, r.u) for r in edges.collect()}
        assert all(sorted(s) == [0, 1, 2, 3] for s in paths.values()) and len(paths) == 6 * 40
        assert all((s[i], s[i + 1]) in pairs for s in paths.values() for i in range(3))
        first = [s[1] for (start, _), s in paths.items() if start == 0]
        assert abs(first.count(5) / len(first) - 6 / 20) < 0.2


def test_projection_blocks_do_not_change_pairs(spark):
    links = spark.createDataFrame([("a", i, 1.0) for i in range(30)] + [("b", 3, 2.0), ("b", 4, 1.0)], "uid string, zone int, weight double")
    full = {(r.u, r.v): r.weight for r in graph.project_sum(links).collect()}
    cutup = {}
    for r in graph.shared_pairs(links, ["weight"], block=4).groupBy("u", "v").agg(F.sum(F.col("weight_u") + F.col("weight_v")).alias("w")).collect():
        cutup[(r.u, r.v)] = r.w
    assert full == cutup and len(full) == 435 and full[(3, 4)] == 5.0


def test_contact_shares(spark):
    c = spark.createDataFrame([("a", 1.0, 1.0, 2.0), ("b", 0.0, 0.0, 0.0)], "uid string, f double, d double, n double")
    got = {r.uid: (r.f, r.d, r.n) for r in experienced.contact_shares(c, ["uid"]).collect()}
    assert got == {"a": (25.0, 25.0, 50.0), "b": (0.0, 0.0, 0.0)}


def test_survey_clock(spark):
    df = spark.createDataFrame([("2024-01-01", "735", "5"), ("2024-01-01", "2350", "10")], "d string, a string, b string")
    t = df.select(survey.parse_clock(F.col("d"), F.col("a")).alias("dep"), survey.parse_clock(F.col("d"), F.col("b")).alias("arr"))
    got = survey.travel_minutes(t, "dep", "arr").collect()
    assert got[0].dep.hour == 7 and got[0].dep.minute == 35 and got[1].travel_time == 20.0 and got[1].arr.day == 2


def test_two_zones(spark):
    df = spark.createDataFrame([("2024-07-01 12:00:00", "Europe/Stockholm"), ("2024-01-01 12:00:00", "Europe/Stockholm"), ("2024-01-01 12:00:00", "Asia/Tokyo")], "u string, tz string")
    got = stays.to_local(df.withColumn("u", F.to_timestamp("u")), "u", "tz", "l").collect()
    assert [r.l.hour for r in got] == [14, 13, 21]


def test_kept_rows_and_keys(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("b", 1, 2)], "k string, t int, v int")
    assert [r.k for r in cleaning.complete_subjects(df, "k", ["v"]).collect()] == ["b"]
    assert {(r.k, r.v) for r in cleaning.first_per(df, ["k"], ["t"], ["v"]).collect()} == {("a", None), ("b", 2)}


def test_axis_and_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "A"), (2, [0.0, 1.0], "B"), (3, [3.0, 0.0], "A")], "id int, embedding array<double>, cls string")
    a = embeddings.axis(df, "cls", "A", "B")
    assert a.first().axis == [2.0, -1.0]
    got = {r.id: r.ab for r in embeddings.project_on(df.select("id", "embedding"), {"ab": a}).collect()}
    assert math.isclose(got[1], 2 / math.sqrt(5)) and math.isclose(got[2], -1 / math.sqrt(5))


@pytest.mark.parametrize("cell", [1, 3, 10])
def test_distance_free_pool_matches_brute_force(spark, cell):
    rng = random.Random(8)
    pois = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice(["Office", "Craft", "Shop"]), f"u{i % 5}") for i in range(120)]
    homes = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(4)]
    people = [(p, *homes[p], "Office", d) for p in range(4) for d in rng.sample(range(0, 25), 6)]
    got = nullmodel.decay_pool(spark.createDataFrame(people, "uid int, x double, y double, tag string, d int"),
                               spark.createDataFrame(pois, "osm_id int, x double, y double, tag string, unit string"), "unit", ["uid"], 1.0, cell)
    got = {(r.uid, r.unit): (r.tier, r.places) for r in got.collect()}
    want = {}
    tier = {"Office": 1, "Craft": 3, "Shop": 0}
    for uid in range(4):
        mine = [(x, y, d) for u, x, y, _, d in people if u == uid]
        hits = [(tier[t], u) for _, px, py, t, u in pois if tier[t] and any(round(math.dist((x, y), (px, py))) == d for x, y, d in mine)]
        low = min(t for t, _ in hits)
        for t, u in hits:
            if t == low:
                want[(uid, u)] = (t, want.get((uid, u), (t, 0))[1] + 1)
    assert got == want


def test_polygons_with_holes_and_parts(spark, tmp_path):
    square = lambda x, y, a: [[x, y], [x + a, y], [x + a, y + a], [x, y + a], [x, y]]
    shapes = [
        (1, "Polygon", [square(0, 0, 4), square(1, 1, 1)]), (2, "Polygon", [square(10, 0, 4), square(11, 1, 1)[::-1]]),
        (3, "MultiPolygon", [[square(20, 0, 2)], [square(30, 0, 3)[::-1], square(31, 1, 1)]]),
        (4, "Polygon", [[[40, 0], [42, 0], [42, 1], [41, 1], [41, 2], [40, 2], [40, 0]]]),
    ]
    lines = [json.dumps({"properties": {"deso": k}, "geometry": {"type": t, "coordinates": c}}) for k, t, c in shapes]
    (tmp_path / "zones.json").write_text("\n".join(lines))
    zones = io.read_features(spark, str(tmp_path / "zones.json"), "deso:int")
    assert dict(zones.select("deso", spatial.polygon_area(F.col("ring"))).collect()) == {1: 15.0, 2: 15.0, 3: 12.0, 4: 3.0}
    at = [(0.5, 0.5, 1), (1.5, 1.5, None), (11.5, 1.5, None), (13.5, 3.5, 2), (21.0, 1.0, 3), (25.0, 1.0, None), (32.5, 0.5, 3), (31.5, 1.5, None), (41.5, 1.5, None), (40.5, 1.5, 4)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(at)], "id int, x double, y double")
    assert dict(spatial.pip_join(points, zones, "x", "y", "deso", 2.0).select("id", "deso").collect()) == {i: k for i, (_, _, k) in enumerate(at) if k}
    houses = spark.createDataFrame([(1, 0.5, 0.5, 2.0), (2, 40.0, 0.0, 2.0), (3, 30.0, 0.0, 3.0)], "building_id int, x double, y double, a double")
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("a")).alias("x"), (F.col("y") + dy * F.col("a")).alias("y"))
    houses = houses.select("building_id", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    got = dict(spatial.ground_space(houses, zones, "deso", 2.0).collect())
    assert all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in {1: 3 / 15, 2: 0.0, 3: 8 / 12, 4: 1.0}.items())
    (tmp_path / "line.json").write_text('{"properties": {"deso": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}')
    with pytest.raises(Exception, match="not a polygon"):
        io.read_features(spark, str(tmp_path / "line.json"), "deso:int").collect()


def test_text_node_ids(spark):
    edges = spark.createDataFrame([("0114B", "0114A", 1.0), ("0114A", "cell 9", 2.0), ("x", "y", 0.0)], "u string, v string, weight double")
    kept, nodes = graph.prune_index(edges)
    assert kept.count() == 2 and sorted(map(tuple, nodes.collect())) == [("0114A", 0), ("0114B", 1), ("cell 9", 2)]


def test_poisson_of_any_mean(spark):
    df = spark.range(20_000).withColumn("u", draws.uniform([F.col("id")], 3))
    for mean in (0.3, 5.0, 16.0, 25.0, 130.0):
        r = df.select(draws.poisson(F.lit(mean), F.col("u")).alias("k")).agg(F.avg("k"), F.var_samp("k"), F.min("k")).first()
        assert abs(r[0] - mean) < 5 * math.sqrt(mean / 20_000) and abs(r[1] / mean - 1) < 0.06 and r[2] >= 0
    assert df.select(draws.poisson(F.lit(0.0), F.col("u")).alias("k")).agg(F.max("k")).first()[0] == 0


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\nno number,y\n3,z\n")
    assert sorted(map(tuple, io.read_raw(spark, str(tmp_path), "id int, name string", header=False).collect())) == [(1, "x"), (3, "z")]
    assert [r["line"] for r in io.malformed(spark, str(tmp_path), "id int, name string", header=False).collect()] == ["no number,y"]


def test_ground_space_pairs_are_met_once(spark):
    """A building over many cells counts once for each zone, and no pair is sorted to drop others."""
    ring = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    shape = "ring array<struct<x:double,y:double>>"
    houses = spark.createDataFrame([(1, ring(0.5, 0.5, 5.0)), (2, ring(9.0, 9.0, 2.0)), (3, ring(-3.0, 2.0, 4.0))], f"building_id long, {shape}")
    zones = spark.createDataFrame([("a", ring(0.0, 0.0, 10.0)), ("b", ring(10.0, 10.0, 10.0)), ("c", ring(-10.0, 0.0, 10.0))], f"deso string, {shape}")
    out = spatial.ground_space(houses, zones, "deso", 1.0)
    assert {k: round(v, 9) for k, v in out.collect()} == {"a": 0.30, "b": 0.01, "c": 0.12}
    assert "first(ring" not in out._jdf.queryExecution().executedPlan().toString()
