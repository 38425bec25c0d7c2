"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the data folder, the local cores and the runs per query
(the best of the warm runs counts).
"""

from __future__ import annotations

import json
import os
import time

from foldstone.session import get_session
from foldstone.workload import QUERIES

HEADLINE = (
    "scan_records", "group_rate", "enrich_left", "feature_matrix", "group_deviation",
    "trailing_windows", "describe_numeric", "quantiles_by_rank", "target_correlations",
    "exact_match_leak", "nearest_match", "stratified_folds", "group_folds", "target_encode_oof",
    "target_encode_full", "auc_by_model", "composite_score", "blend_weight_search",
    "blend_simplex_search", "calibration_grid", "nested_calibration", "pseudo_threshold_counts",
    "verify_predictions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.log.level": "ERROR"})
    QUERIES["scan_records"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        seconds[name] = round(min(times), 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
