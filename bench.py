"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one line of JSON.

Every query is said on standard error as it finishes. Queries that would begin after $BENCH_SECONDS are left out and
named, so that the line always comes.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from marklake.plans import catalog

HEADLINE = ("f07_fm_search", "f07_search_compound", "f08_unique_collisions", "f12_set", "q01_field_operators", "s01_headings", "s03_toc", "j05_resolve", "j09_backlinks", "j10_assess_types", "r03_rules_validate", "i01_identity", "k01_okf_validate", "io12_csv", "v03_snapshot")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "1m").config("spark.sql.files.openCostInBytes", "64k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, left, began = {}, [], time.perf_counter()
    most = float(os.environ.get("BENCH_SECONDS", "1200"))
    for name in HEADLINE:
        times = []
        if time.perf_counter() - began > most:
            left.append(name)
            continue
        for k in range(1 + runs):  # the first run warms up
            if k > 1 and time.perf_counter() - began > most:
                break
            start = time.perf_counter()
            catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        measured = sorted(times[1:] or times)
        took[name] = round(measured[(len(measured) - 1) // 2], 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "not_run": left}), flush=True)


if __name__ == "__main__":
    main()
