"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from devicehealth.catalog import load  # noqa: E402
from devicehealth.session import SETTINGS  # noqa: E402

HEADLINE = (
    "p1_coerce_numeric a1_host_means a2_host_overview a5_describe a7_matrix_quantile a10_correlation a15_histogram f2_at_or_above_quantile "
    "f7_last_points w5_top_per_group w9_latest_snapshot l5_extreme_flags l6_diagnosis l3_quantile_segments t7_chat_markup j2_reading_x_threshold "
    "j5_resolve_users j8_latest_alert d1_detect d2_alert_lines t4_rendered_alerts d4_rediagnosis e1_regression_scores e3_roc_auc x3_root_causes "
    "g1_seasonal_forecast g2_regular_grid c3_dbscan m5_forest_regression"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
