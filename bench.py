"""Seconds per query on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

The ETL queries come first; then publishing each flat table (its ETL and its
Parquet output) is timed, once; the other queries run on the published tables.
Each query runs once untimed, so that code generation is not part of the
figure, and the better of two timed runs counts.  Results go to the "noop"
sink: every row is computed, none is collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from facetspark.plans.catalog import QUERIES
from facetspark.plans.fixtures import published_tables


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("facetspark-bench")
        # no Python call-site capture: it triples the driver round trips of building a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def warm(name: str) -> float:
        run(name)
        return min(run(name), run(name))

    flatten = [name for name in QUERIES if name.startswith("etl_")]
    seconds = {name: warm(name) for name in flatten}
    for table in ("main", "tags", "children"):
        start = time.perf_counter()
        getattr(published_tables(spark, sf_dir), table)
        seconds[f"publish_{table}"] = time.perf_counter() - start
    seconds.update((name, warm(name)) for name in QUERIES if name not in flatten)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
