"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q7_verdicts_by_field", "r8_rule_usage", "h4_verdict_counts", "h5_top_violated", "s6_upsert_history",
    "f1_line_windows", "f3_match_key", "f11_mrp_cascade", "f13_mfg_keyed", "p8_score_passes", "p14_chars_in_roi",
    "m3_height_consistent", "m7_level_crossing", "q3_planarity", "c4_consensus_height", "e2_height_stats_by_field",
    "e7_field_stats", "e14_band_sweep",
]


def main() -> None:
    from packaudit.session import local_session
    from verification import catalog
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
