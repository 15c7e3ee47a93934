"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from occuspan.plans.queries import registered
from occuspan.session import local_session

HEADLINES = (
    "normalized_snapshot",
    "drop_report",
    "spans",
    "logical_stores",
    "place_turnover",
    "places",
    "place_history",
    "region_stats",
    "top_turnover",
    "viewport_places_batch",
    "place_detail",
    "snapshot_diff",
    "missing_profile",
    "quality_checks",
)


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = local_session("occuspan-bench", cores, "12g")
    spark.read.parquet(f"{data}/lineitem.parquet").count()  # start the JVM's readers before timing
    queries = registered()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, data).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    sf = Path(data).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
