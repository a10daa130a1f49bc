"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from asof_spark.plans import registry

HEADLINE = ("a1_schedule", "c3_dedupe_snapshots", "d3_form", "d9_pitcher_window", "d11_league_asof", "d15_park_factors", "d17_build_features", "e5_replay_elo", "h1_evaluate", "h2_auc", "h5_reliability", "i3_settle", "j4_rank_league", "j7_win_distribution", "k3_home_win_rate", "l1_log_coverage", "l14_recompute")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    spark = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = registry.queries(), {}
    for name in ("b2_type_counts", *HEADLINE):
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    seconds.pop("b2_type_counts")  # warms the session
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
