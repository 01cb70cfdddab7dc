"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
Each query runs to completion into a sink that discards rows.  ``scan`` reads,
extracts and builds the source graph; the later ones start from its tables.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "extract_js", "extract_python", "extract_java", "suffix_index", "resolve_alias",
    "build_nodes", "most_connected", "adjacency", "keyword_search", "god_nodes", "degrees",
    "capped_neighbours", "pagerank", "pagerank_source", "smart_edges", "node_pages",
    "decode_text", "page_names", "communities",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("codeloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workload.queries import REGISTERED, scanned

    spark.range(1000).repartition(4).count()
    seconds: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("scan", lambda: scanned(spark, sf_dir))
    for name in HEADLINE:
        run = REGISTERED[name][0]
        timed(name, lambda: run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(match.group(1)) if match else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
