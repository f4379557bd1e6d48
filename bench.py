"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from tidewell.plans import catalog
from tidewell.session import local_session

HEADLINE = [
    "d3_product_availability", "c3_derive_status", "c2_relevant_products", "d7_cluster_cells", "d11_cost_rollup", "b1_normalize_facilities",
    "b5_dedup_keep_latest", "b7_conform_text", "b14_strict_diff", "e2_extract_blocks", "e4_extract_links", "e9_merge_events", "e20_detect_changes",
    "e22_pending_work", "e28_localize_labels", "h2_even_sample", "h3_field_mismatches", "g1_newest_log", "c8_search_score", "c13_nearest_k", "c12_match_requests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
