"""Headline queries at one scale: prints one line of JSON.

Each query is run to the end without collecting its rows. A first small run warms
the JVM; every timing includes putting the plan together.
"""

from __future__ import annotations

import json
import os
import sys
import time

from veilspark.plans.queries import QUERIES
from veilspark.session import local_session

HEADLINE = (
    "anonymize_documents", "anonymize_pages", "anonymize_turns", "anonymize_messages",
    "batch_totals", "audit_pattern_counts", "mapping_build", "mapping_merge",
    "stats_by_type", "stats_export", "records_clean", "name_origin", "detect_gazetteer",
    "config_upsert_types", "windowed_scan",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    small = os.path.join(os.path.dirname(folder), "sf0.001")
    if os.path.isdir(small):
        QUERIES["anonymize_documents"](spark, small).write.format("noop").mode(
            "overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
