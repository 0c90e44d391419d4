"""Time the headline queries on local[$BENCH_CPUS] and print one JSON line.

Every query starts from the Parquet tables: nothing staged by an earlier query
is reused.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks import catalog
from trialquota.sources.staging import drop_staged

HEADLINE = (
    "v6_integrity", "h1_split", "e1_category_levels", "a4_effect_table", "a8_balance_table", "a10_roc_auc_continuous",
    "m5_cross_fit", "m11_cell_predictions", "p10_value_grid", "q5_display_curve", "b3_blocked_bootstrap", "b7_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    queries = catalog.registered()
    seconds = {}
    for name in HEADLINE:
        catalog.forget_runs()
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
