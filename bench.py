"""Headline queries on the given tables; prints one JSON line.

Each query is run once to warm up and then timed, plan building included; the time is the best of the timed runs.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import all_queries  # noqa: E402
from tallyhouse.session import build_session  # noqa: E402

HEADLINE = [
    "cross_service_monthly",
    "demographics_profile",
    "events_person_month",
    "pantry_served_person_month",
    "service_flags",
    "rejected_events",
    "multi_dob_people",
    "similar_names",
    "person_merge",
    "household_merge",
    "latest_fields",
    "csv_round_trip",
    "rebuild_all",
    "similar_names_any_block",
    "similar_names_by_sound",
    "similar_names_top",
    "cross_service_from_store",
    "stream_ingest",
    "cross_service_from_bits",
    "cross_service_36_months",
    "person_merge_linked",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=scratch,
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    for name in HEADLINE:
        best = None
        for run in range(runs + 1):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            if run and (best is None or took < best):
                best = took
        times[name] = round(best, 3)
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf})
    )


if __name__ == "__main__":
    main()
