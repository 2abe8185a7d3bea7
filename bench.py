"""Times the headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one line of JSON.

Each query is run whole, its result written to the no-op sink; the time is the better of two runs after one small one to compile.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = (
    "snapshot_scan snapshot_latest_agg multi_get_asof tombstone_keys compaction_survivors ordered_version_scan seek_lower_bound next_prev range_scan "
    "reverse_scan_topk prefix_scan contains_keys internal_key_encode varint_encode_hex hash32_int_key crc32c_text escape_text bloom_probe_no_false_negative "
    "block_filter_prune log_roundtrip entry_size_stats stream_latest_state join_aggregate cube_counts sessions"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.plans import catalogue
    from tidemark.session import ship_package

    ship_package(spark)
    took: dict[str, float] = {}
    for name in QUERIES:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
