"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lurescope.plans.queries import REGISTRY  # noqa: E402
from lurescope.session import local_session  # noqa: E402

HEADLINES = [
    "url_features",
    "url_features_mutated",
    "url_flag_summary",
    "dns_enrich",
    "drift_report",
    "url_feature_drift",
    "validation_drift",
    "seeded_split",
    "knn_impute",
    "robust_scale",
    "weighted_metrics",
    "champion_gate",
    "verdicts",
    "scan_history_topk",
    "history_summary",
    "report_markdown",
    "report_dedup",
    "investigation_report",
    "transcript_parts",
    "adaboost_rounds",
    "stream_scan_parity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/pages.parquet").count()  # start-up is not a query
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
