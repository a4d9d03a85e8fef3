"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores). Each query runs in full into
Spark's no-op sink, once to warm up and then ``BENCH_RUNS`` times; the least time counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

QUERIES = ("assign_rfu", "cellranger_adapter", "rfu_metrics_cell", "pseudobulk_counts", "overlap_cosine", "repertoire_cell", "flagship")


def main() -> None:
    from pyspark.sql import SparkSession

    from clonoform.plans.registry import QUERIES as ALL

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in QUERIES:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "2"))):
            began = time.perf_counter()
            ALL[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs[1:] or runs), 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    line = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
