"""Time the headline queries; prints one JSON line. Settings: BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalog import QUERIES  # noqa: E402
from catalog.fixtures import Tables  # noqa: E402
from copresence.session import use_local_folder  # noqa: E402

HEADLINE = [
    "zone_halfhour_segregation", "zone_visitor_profile", "mixed_unit_segregation", "experienced_segregation", "place_group_mix",
    "contact_shares", "person_place_links", "record_weights", "picked_homes", "device_weights", "mobility_metrics", "ping_deltas",
    "location_runs", "detected_stays", "pings_in_stays", "user_stats", "weighted_group_stats", "interpolated_quantiles",
    "heterogeneity_table", "rank_correlation", "weighted_rank_test", "candidate_pool", "replicate_draws", "nearest_place",
    "places_in_zones", "summed_projection", "trip_activities", "od_matrices", "residential_segregation", "axis_projection",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{took[name]:8.2f} {name}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
