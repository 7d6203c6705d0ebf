"""Replicates as vectors: the draws of the long form, medians by brute force, and one shuffled row per visit."""

import math
import statistics

from pyspark.sql import functions as F

from copresence.functions import time_bins
from copresence.operators import experienced, nullmodel, place, replicates


def pick(keys):
    return nullmodel.hashed(5)(keys)


def test_vectors_hold_the_draws(spark):
    stops = spark.createDataFrame([(i, i % 4, 100 + i) for i in range(60)], "sid int, k int, home int")
    pool = spark.createDataFrame([(k, u, 1 + (k * u) % 3) for k in range(3) for u in range(1, 9)], "k int, unit int, places long")
    long = nullmodel.draw(stops, pool, ["k"], "unit", ["sid"], 7, pick).collect()
    got = {r.sid: r.nos for r in replicates.draw_vector(stops, pool, ["k"], "unit", ["sid"], 7, pick).collect()}
    assert len(long) == 420 and len({r.unit_s for r in long}) == 9  # eight units, and null where there is no pool
    for r in long:
        assert (got[r.sid] and got[r.sid][r.sim - 1]) == r.unit_s
    assert got[3] is None


def test_counted_and_single_draws_of_vectors(spark):
    stops = spark.createDataFrame([(i, i % 4, 100 + i) for i in range(60)], "sid int, k int, home int")
    pool = spark.createDataFrame([(k, u, 1 + (k * u) % 3) for k in range(3) for u in range(1, 9)], "k int, unit int, places long")
    long = nullmodel.draw(stops, pool, ["k"], "unit", ["sid"], 7, pick)
    vectors = replicates.draw_vector(stops, pool, ["k"], "unit", ["sid"], 7, pick)
    single = replicates.each_draw(vectors, "unit", 7)
    assert sorted(((r.sid, r.sim, r.unit_s, r.home) for r in single.collect()), key=repr) == sorted(((r.sid, r.sim, r.unit_s, r.home) for r in long.collect()), key=repr)
    counts = [sorted(map(tuple, f(d, ["sid"], "unit").collect())) for f, d in ((nullmodel.draw_counts, long), (replicates.draw_counts, vectors))]
    assert counts[0] == counts[1] and counts[0]


def test_medians_of_small_and_of_counted_keys(spark, monkeypatch):
    nan = float("nan")
    rows = [(k, [None if (k + i) % 5 == 0 else nan if (k + i) % 7 == 0 else float((i * 37 + s * k) % 11) for s in range(3)]) for k in range(9) for i in range(1 + 4 * k)]
    rows += [(90, [None, nan, 2.0])]
    df = spark.createDataFrame(rows, "k int, values array<double>")
    for held in (50_000, 3):  # three rows at most: the others are counted by value, also from batch to batch
        monkeypatch.setattr(replicates, "HELD", held)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4 if held == 3 else 10_000)
        try:
            got = {r.k: r.values for r in replicates.medians(df, ["k"], 3).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(got) == {k for k, _ in rows}
        for k, values in got.items():
            for s, value in enumerate(values):
                seen = [v[s] for key, v in rows if key == k and v[s] is not None]
                real = [v for v in seen if not math.isnan(v)]
                if real:
                    assert value == statistics.median(real)
                else:
                    assert value is None if not seen else math.isnan(value)


def test_vectors_meet_what_spans_meet(spark, monkeypatch):
    """Equal to the long form with places in one block and in many; rows are dealt by person and half hour without a replicate."""
    visits = spark.createDataFrame([(i % 5, i % 2, 0, i % 9, (i * 7) % 40 + 1) for i in range(80)], "uid int, weekday int, holiday int, unit int, lo int")
    visits = visits.withColumn("time_span", F.array(F.struct("lo", (F.col("lo") + 2).alias("hi")))).drop("lo").withColumn("sid", F.monotonically_increasing_id())
    index = spark.createDataFrame([(u, w, 0, t, None if (u + t) % 6 == 0 else (u * 31 + t * 17) % 23 / 10, 0.1, 1) for u in range(8) for w in (0, 1) for t in range(1, 44) if (u + t) % 4],
                                  "unit int, weekday int, holiday int, time_seq int, ice_birth double, evenness_income double, num_unique_uid long")
    sims = visits.withColumn("sim", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)]))).withColumn("unit", (F.col("unit") * F.col("sim") % 9).cast("int"))
    keys = ["uid", *experienced.CELL, "sim"]
    want = {tuple(r[k] for k in keys): r.ice_birth for r in experienced.experienced_spans(sims, index, "unit", ["sim"]).collect()}
    for bits in (10, 1):
        monkeypatch.setattr(replicates, "BITS", bits)
        numbers = replicates.numbered(index, "unit")
        no = {r.unit: r.no for r in numbers.collect()}
        lookup = F.create_map(*[F.lit(x) for kv in no.items() for x in kv])
        vectors = visits.withColumn("nos", F.array(*[F.try_element_at(lookup, (F.col("unit") * s % 9).cast("int")) for s in (1, 2, 3)]))
        met = replicates.met_vectors(vectors, replicates.cells(index, numbers, "unit", "ice_birth", experienced.CELL), 3)
        assert "sim" not in met._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r[k] for k in keys): r.ice_birth for r in replicates.per_replicate(met).collect()}
        assert got.keys() == want.keys()
        assert all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) < 1e-12) for k, a in got.items())


def test_means_of_vectors(spark):
    nan = float("nan")
    rows = [(1, 1, 0, 1, [1.0, 3.0, None]), (1, 1, 0, 2, [nan, 8.0, 8.0]), (2, 1, 0, 1, [None, None, None]), (3, 1, 0, 1, [nan, None, nan])]
    df = spark.createDataFrame(rows, "uid int, weekday int, holiday int, time_seq int, ice_birth array<double>")
    assert {r.uid: r.ice_birth for r in replicates.vector_mean(df).collect()} == {1: 5.0, 3: None}


def test_contacts_of_vectors(spark):
    """Equal to the links and mixes of the long form, with persons whose half hour runs over several batches."""
    visits = spark.createDataFrame([(i % 3, 1, 0, (i * 7) % 5 + 1, 1.0 + i % 4, [i % 4, (i * 3) % 5]) for i in range(90)], "uid int, weekday int, holiday int, lo int, wt_total double, nos array<bigint>")
    visits = visits.withColumn("time_span", F.array(F.struct("lo", (F.col("lo") + 1).alias("hi")))).drop("lo")
    groups = spark.createDataFrame([(0, "F", 2.0), (1, "D", 3.0), (2, "N", 5.0)], "uid int, grp_r string, wt_p double")
    bins = time_bins.explode_bins(visits).select("*", F.posexplode("nos").alias("s", "unit")).withColumn("sim", F.col("s") + 1)
    links = place.links(bins, "unit", ["time_seq", "sim"])
    mix = place.place_mix(links.join(groups, "uid"), ["unit", "time_seq", "sim"])
    want = {(r.uid, r.sim): (r.f, r.d, r.n) for r in experienced.person_contact(links, mix, ["unit", "time_seq", "sim"], True, ["sim"]).collect()}
    for most in (10_000, 4):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = {(r.uid, r.sim): (r.f, r.d, r.n) for r in replicates.contacts(visits, replicates.mix_cells(visits, groups, 2)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want and len(want) == 6


def test_series_of_persons_and_their_classes(spark):
    """A person's vectors taken apart to one array for each replicate, also from batch to batch, hold what the long form holds; classes agree."""
    from copresence.operators import series
    nan = float("nan")
    value = lambda u, h, s: None if (u + s) % 4 == 0 or s == 2 and u % 2 else nan if (u * h + s) % 9 == 0 else ((h * 37 + s * 11 + u * 5) % 23 - 9) / 20
    rows = [(u, [value(u or 0, h, s) for s in range(6)]) for u in (*range(12), None) for h in range(1 + 3 * (u or 7))]
    df = spark.createDataFrame(rows, "uid int, ice_birth array<double>")
    long = replicates.per_replicate(df)
    want = {}
    for r in long.collect():
        want.setdefault((r.uid, r.sim), []).append(r.ice_birth)
    ordered_by = lambda v: sorted(v, key=repr)
    for batch in (10_000, 5):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            whole = replicates.series_per_replicate(df, ["uid"]).withColumn("average", replicates.list_mean("ice_birth"))
            got = {(r.uid, r.sim): r for r in whole.collect()}
            classes = {(r.uid, r.sim): r.grp for r in series.classes(whole, ["uid", "sim", "average"], "ice_birth", 0.0).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(got) == set(want) and len(want) > 40
        for k, values in want.items():
            real = [v for v in values if v is not None]
            assert ordered_by(got[k].ice_birth) == ordered_by(values)
            assert got[k].average is None if not real else math.isclose(got[k].average, statistics.mean(real), abs_tol=1e-12)
        assert classes == {(r.uid, r.sim): r.grp for r in series.classes(long, ["uid", "sim"], "ice_birth", 0.0).collect()}
        assert len(set(classes.values())) > 2


def test_person_table_makes_no_row_per_half_hour(tables, monkeypatch):
    """The series of a person and replicate stay in one array from the vectors to their class."""
    from catalog import QUERIES
    monkeypatch.setattr(replicates, "per_replicate", lambda df: 1 / 0)
    assert QUERIES["replicate_person_table"](tables).where("sim = 50").count() > 0
