"""Time the headline queries: prints one JSON line.

Each query runs once to warm up and is then timed with a write to the noop
sink, so that every column of every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from ledgerlens.plans.registry import load
from ledgerlens.session import build_session

HEADLINE = [
    "entity_group_stats",
    "a01_group_stats_many_keys",
    "a03_key_combinations",
    "a08_period_share",
    "a12_category_variety",
    "e01_label_encode",
    "e06_quantile_bins",
    "g01_block_ids",
    "g03_greedy_chains",
    "g04_progress_components",
    "g06_split_on_jumps",
    "g10_knn_regression",
    "l03_cross_validation",
    "m12_blend_search",
    "d07_two_sample_ks",
    "j09_hour_counter_partners",
    "m06_auc",
    "m07_auc_by_segment",
    "p03_pair_ratios",
    "t03_leave_month_out",
    "t05_period_profile",
    "w02_day_gaps",
    "w03_trailing_mean",
    "w05_trailing_amount",
    "w07_hour_counts",
    "w11_relative_to_group",
    "w14_ranks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    registered, times = load(), {}
    for name in HEADLINE:
        for _ in range(2):
            t0 = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
