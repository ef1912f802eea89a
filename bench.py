"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewire.plans.catalog import QUERIES  # noqa: E402
from tidewire.session import local_session  # noqa: E402

HEADLINE = (
    "batch_metrics",
    "decayed_statistics",
    "jitter_statistics",
    "two_role_statistics",
    "link_covariance",
    "traffic_features",
    "link_features",
    "peek_statistics",
    "frequency",
    "anchored_windows",
    "multilayer_graph_edges",
    "degree_features",
    "largest_component_ratio",
    "shortest_path_measures",
    "neighbour_propagation",
    "edge_versions",
    "running_scale",
    "standard_scale",
    "ks_statistic",
    "concept_drift",
    "adaptive_threshold",
    "deviation_scores",
    "reconstruction_scores",
    "pool_scores",
    "kernel_cka",
    "file_batch_metrics",
    "detection_summary",
    "best_parameters",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # One small run so that the first query is not charged for starting up.
    QUERIES["positives"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
