"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from plumeline.plans.queries import queries
from plumeline.session import local_session

HEADLINE = [
    "nation_forecast",
    "forecast_best",
    "backtest_mape",
    "poly_forecast_d2",
    "arima_search",
    "scenario_gap",
    "policy_pathway",
    "annual_fraction",
    "commitments_validate",
    "score_points",
    "product_slate",
    "catalyst_matrix",
    "optimal_conditions",
    "grid_search_top10",
    "grid_heatmap",
    "training_table",
    "profile_describe",
    "confidence",
    "unknown_category",
    "label_codes",
    "boost_nodes",
    "gbt_metrics",
    "gbt_cross_validation",
    "gbt_learning_curve",
    "gbt_predict",
    "route_predictions",
]
RUNS = 3
ONCE = {"boost_nodes", "gbt_metrics"}  # training: `gbt_metrics` grows the models of both targets and all folds, which the queries behind it then share


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    known = queries()
    known["regions_distinct"](spark, folder).count()  # starts the session's workers before the clock runs
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(1 if name in ONCE else RUNS):
            began = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(median(taken), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
