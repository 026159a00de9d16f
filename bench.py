"""Headline queries, warm, written to the ``noop`` sink. Prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from sitemill.session import builder  # noqa: E402

HEADLINE = [
    "health_rollup_24h",
    "health_status",
    "last_run",
    "log_errors",
    "feed_profile",
    "feed_normalized",
    "catalog_enriched",
    "qa_rollup",
    "brand_map_apply",
    "brand_canonical",
    "cdx_captures",
    "clean_website",
    "route_pages",
    "extract_records",
    "archive_records",
    "upsert_items",
    "dedupe_last",
    "knn_cosine",
    "embed_hash",
    "density_clusters",
    "cluster_summary",
]

#: Queries whose input is one or two files here: their rows are dealt out to all cores.
DEALT = {"extract_records", "embed_hash"}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        builder("bench", f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            options = {"tasks": int(cpus)} if name in DEALT else {}
            QUERIES[name](spark, sf, **options).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
