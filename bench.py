"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads, ``BENCH_QUERIES`` a comma
list of queries or ``all``. Each figure is the median of the warm runs of the whole
query, planning included, without the first; a query that takes long is run twice.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m10_changes_only",
    "m10_change_ratio",
    "m11_fill_forward",
    "m12_recent",
    "m13_assign_batch",
    "m15_delivery_plan",
    "m17_resample",
    "m6_metrics_json",
    "m8_health",
    "j1_traffic_report",
    "w9_ip_access",
    "w2_w3_percent_round_trip",
    "e1_explode_headers",
    "e3_envelope",
    "e16_threads",
    "e17_received_hops",
    "e5_decode_words",
    "e30_explode_parts",
    "e33_decode_parts",
    "e35_choose_encoding",
    "e40_attachment_inventory",
    "e44_duplicates",
    "e49_text_quality",
    "e62_expunge",
    "e65_diff_listing",
    "e70_to_ranges",
    "e72_select_set",
    "t1_change_stream",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("postmeter-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from postmeter.workloads import QUERIES

    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    # Start-up of the session, the scan and the first code generation are not a query's time.
    QUERIES["m10_change_ratio"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        runs: list[float] = []
        while len(runs) < 2 or (len(runs) < 3 and sum(runs) < 12):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        # The first run also compiles code and is left out.
        times[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
