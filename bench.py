"""Time the headline queries: one JSON line on standard output.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
Each query runs once to warm up and three times for the median; results go to
a sink that discards them. Shuffle bytes are those written in one run.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from sweepfield.session import build_session

HEADLINES = [
    "local_minima", "curve_metrics", "band_compliance", "best_so_far",
    "self_intersections_touch", "minimum_gap", "nearest_distances", "label_colors",
]
RUNS = 3


def shuffle_bytes(spark) -> int:
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        })
    spark.sparkContext.setLogLevel("ERROR")
    from sweepfield import catalog

    queries = catalog.queries()
    times, shuffled = {}, {}
    for name in HEADLINES:
        runs = []
        for attempt in range(RUNS + 1):
            before = shuffle_bytes(spark) if attempt == RUNS else 0
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            if attempt == RUNS:
                shuffled[name] = shuffle_bytes(spark) - before
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline query time, warm median of 3, summed", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "shuffle_bytes": shuffled,
        "cpus": cpus, "shuffle_partitions": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
