"""Devices of few pings are one group; crowded ones are cut into slots. Both ways give the same stays."""

import random

from copresence.operators import ordered, quantiles, stays

HOUR = 3600


def trace(spark, devices=4, n=60):
    """Pings that stay a while at one of a few places."""
    rows, pid = [], 0
    for d in range(devices):
        rng, t = random.Random(d), 0
        while n and t < n * HOUR:
            place = rng.randrange(4)
            for _ in range(rng.randrange(1, 6)):
                t += rng.choice([300, 900, 2 * HOUR, 7 * HOUR])
                rows.append((d, t, pid, 55.0 + place * 0.01 + rng.random() * 1e-4, 12.0 + rng.random() * 1e-4))
                pid += 1
    return spark.createDataFrame(rows, "device_aid int, timestamp long, pid long, latitude double, longitude double")


def found(pings):
    order = ["timestamp", "pid"]
    crowded = stays.crowded_devices(pings)
    points = stays.detect_stops(stays.densify(pings, order, 3 * HOUR, crowded), order, crowded=crowded)
    return crowded, sorted(map(tuple, stays.stays_from_points(points).collect()))


def test_crowded_devices_have_the_same_stays(spark, monkeypatch):
    pings = trace(spark)
    none, plain = found(pings)
    sizes = sorted(r["size"] for r in ordered.sizes(pings, ["device_aid"]).collect())
    monkeypatch.setattr(ordered.crowded, "__defaults__", (sizes[1],))  # some devices are crowded, some not
    monkeypatch.setattr(quantiles, "FEW", 2)
    some, mixed = found(pings)
    assert none is None and 0 < some.count() < 4
    assert mixed == plain and plain


def test_runs_of_a_device_need_one_shuffle(spark):
    pings = trace(spark).withColumnRenamed("pid", "loc")
    plan = stays.run_id(pings, ["timestamp"], 3 * HOUR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_medians_of_arrays_and_of_pieces_are_equal(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, float("nan"), -0.0, round(rng.gauss(0, 3), 1)]), rng.random()) for k in range(5) for _ in range(k * 7 + 1)]
    df = spark.createDataFrame([*rows, (9, None, float("nan"))], "k int, x double, y double")
    a, b = (sorted(map(tuple, f(df, ["k"], ["x", "y"]).collect()), key=repr) for f in (quantiles.medians, quantiles.medians_by_pieces))
    assert a == b and len(a) == 5
