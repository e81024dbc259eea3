"""Headline benchmark: runs the main queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is materialised with the no-op sink (full execution, nothing collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadlens.plans.registry import load_all  # noqa: E402
from roadlens.session import build_session, clear_scratch  # noqa: E402

HEADLINE = ["val_combined", "dup_detect", "km_fit_by_type", "impute_end_datetime", "encode_features",
            "playbook_lookup", "nearest_node", "knn_graph", "weather_asof", "drift_mae", "latency_fallback",
            "news_for_incident", "vector_topk", "service_error_rate", "dq_threshold_alerts",
            "score_incidents", "stream_dq", "stream_dup_detect", "alert_dedup", "snk_geojson", "src_csv_incidents"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    spark = build_session("roadlens-bench", cpus=cpus, shuffle_partitions=max(8, int(cpus) * 2))
    reg = load_all()
    # warm-up: JVM, Python workers, codegen caches
    reg["derive_grid"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t0 = time.time()
        reg[k].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
