from pyspark.sql import functions as F

from copresence.functions import text, time_bins
from copresence.operators import profiles


def spans(spark, rows):
    df = spark.createDataFrame(rows, "h double, d double")
    s = df.select("h", "d", time_bins.stay_span(F.col("h"), F.col("d")).alias("s"))
    return [(r.h, [(x.lo, x.hi) for x in r.s], r.bins, r.n) for r in s.select(
        "h", "s", time_bins.span_bins(F.col("s")).alias("bins"), time_bins.span_length(F.col("s")).alias("n")).collect()]


def test_edges_and_midnight(spark):
    got = spans(spark, [(0.0, 10.0), (0.5, 0.0), (0.5, 1.0), (23.5, 60.0), (23.75, 15.0), (8.0, 90.0)])
    assert got[0][1] == [(1, 1)]
    assert got[1][1] == [(1, 1)]  # exactly .5 belongs to the first bin
    assert got[2][1] == [(1, 2)]
    assert got[3][1] == [(1, 1), (47, 48)] and got[3][2] == [1, 47, 48] and got[3][3] == 3
    assert got[4][1] == [(48, 48)]  # ends exactly at midnight: nothing wraps
    assert got[5][1] == [(16, 19)]


def test_profile_range_is_inclusive_and_clipped(spark):
    df = spark.createDataFrame([(0.0, 30.0), (23.75, 29.9), (1.0, 5000.0)], "h double, d double")
    lo, hi = time_bins.profile_range(F.col("h"), F.col("d"))
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(0, 1), (47, 48), (2, 95)]


def test_profile_mass_and_weights(spark):
    df = spark.createDataFrame([("a", 0.0, 29.0), ("a", 0.1, 29.0), ("a", 10.0, 20.0), ("a", 23.9, 30.0)], "uid string, h_s double, dur double")
    t = {r.half_hour: r.freq for r in profiles.tempo(df, ["uid"]).collect()}
    assert len(t) == 48 and sum(t.values()) == 2 + 1 + 1 + 2 and t[0] == 3
    wt = [r.wt for r in profiles.record_weights(df, ["uid"]).orderBy("h_s").collect()]
    # peak 3: bin 0 weighs 1, bin 1 (second stay runs to minute 35) weighs 3; the part past midnight falls off
    assert wt == [1.0, 4.0, 3.0, 3.0]


def test_text_forms(spark):
    df = spark.createDataFrame([("{3,5}", "{'z1': 2, 'z2': 1}"), ("{1,2,47,48}", "{}")], "s string, c string")
    rows = df.select(time_bins.span_bins(text.parse_span(F.col("s"))).alias("b"), text.expand_counter(F.col("c")).alias("e")).collect()
    assert rows[0].b == [3, 4, 5] and sorted(rows[0].e) == ["z1", "z1", "z2"]
    assert rows[1].b == [1, 2, 47, 48] and rows[1].e == []


def test_profile_of_everybody(spark):
    df = spark.createDataFrame([(0.0, 29.0), (0.1, 29.0), (10.0, 20.0)], "h_s double, dur double")
    t = {r.half_hour: r.freq for r in profiles.tempo(df, [], norm=True).collect()}
    assert len(t) == 48 and t[0] == 1.0 and t[1] == 0.5 and t[20] == 0.5 and t[30] == 0.0
