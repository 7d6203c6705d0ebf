"""The sweep against one run of the detector for every setting."""

import numpy as np
import pytest

from copresence.operators import ordered, stays, stop_sweep

NORTH = 1 / 111_195  # degrees of a metre
HOURS = [1, 2, 3, 5, 8, 12]


def trace(seed, device, n, step):
    """Jitter around a few places with silences near the settings' lengths, and around twice their lengths."""
    rng = np.random.default_rng(seed)
    t, rows, place = 0, [], 0.0
    for _ in range(n):
        if rng.random() < 0.15:
            place = float(rng.choice([0, 20, 45, 200]))
        rows.append((device, int(t), 59 + (place + rng.normal(0, step)) * NORTH, 18.0 + rng.normal(0, step) * NORTH))
        hours = rng.choice(HOURS)
        t += int(rng.choice([0, 60, 300, 600, 1800, 3599, 3600, 3601, hours * 3600 - 1, hours * 3600, hours * 7200 - 1, hours * 7200, 90_000],
                            p=[.04, .2, .2, .2, .1, .02, .02, .02, .05, .05, .04, .04, .02]))
    return rows


@pytest.mark.parametrize("step", [3, 14])
def test_equals_single_runs(spark, step):
    rows = trace(1, "a", 700, step) + trace(2, "b", 60, step) + [("c", 5, 59.0, 18.0)]
    pings = stays.clean_pings(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "device_aid string, timestamp long, latitude double, longitude double, pid long"))
    order = ["timestamp", "pid"]
    out = stop_sweep.sweep(pings, order, [h * 3600 for h in HOURS]).collect()
    for hours in HOURS:
        t = hours * 3600
        alone = stays.stays_from_points(stays.detect_stops(stays.densify(pings, order, t), order, t_max=t))
        want = sorted((r.device_aid, r.start, r.end, r.size, r.loc) for r in alone.collect())
        assert sorted((r.device_aid, r.start, r.end, r.size, r.loc) for r in out if r.t_max == t) == want and len(want) > 5


@pytest.mark.parametrize("step", [3, 14])
def test_crowded_devices_have_the_same_stays(spark, monkeypatch, step):
    """The steps of a device in one task and as tables; a device that spans batches; places that are linked over cells."""
    rows = trace(1, "a", 300, step) + trace(2, "b", 60, step) + trace(3, "c", 60, 25) + [("d", 5, 59.0, 18.0)]
    rows += [("e", i * 1000 + j * 100, 59 + (i * 25 + j % 2) * NORTH, 18.0) for i in range(6) for j in range(10)] + [("e", 900, 58.0, 18.0)]
    pings = stays.clean_pings(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "device_aid string, timestamp long, latitude double, longitude double, pid long"))
    order, t_max = ["timestamp", "pid"], [h * 3600 for h in HOURS]
    found = lambda: sorted(map(tuple, stop_sweep.sweep(pings, order, t_max).collect()))
    plain = found()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert found() == plain
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most in (100, 0):  # the first device, and all devices
        monkeypatch.setattr(ordered.crowded, "__defaults__", (most,))
        assert found() == plain and len(plain) > 100


def test_devices_of_few_pings_are_shuffled_once(spark):
    pings = spark.createDataFrame(trace(2, "b", 60, 3), "device_aid string, timestamp long, latitude double, longitude double")
    plan = stop_sweep.sweep(pings, ["timestamp"], [3600, 7200])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_stats(spark):
    rows = [("a", 3600, 1, 0, 3600, 4), ("a", 3600, 1, 0, 1800, 3), ("b", 3600, 2, 0, 7200, 1), ("a", 7200, 1, 0, 7200, 10)]
    df = spark.createDataFrame(rows, "device_aid string, t_max long, loc int, start long, end long, size long")
    got = {r.hours: r for r in stop_sweep.sweep_stats(df).collect()}
    one = got[1]
    assert (one.stays, one.dur_min, one.dur_max, one.dur_med) == (3, 30.0, 120.0, 60.0) and abs(one.dur_thre - 2 / 3) < 1e-9
    assert (one.sfre_min, one.sfre_max, one.sfre_med) == (0.5, 6.0, 4.0) and abs(one.sfre_one - 2 / 3) < 1e-9
    assert (got[2].dur_thre, got[2].sfre_one) == (1.0, 1.0)
