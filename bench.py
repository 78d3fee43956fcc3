"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trialmill.plans import catalog  # noqa: E402
from trialmill.session import local_session  # noqa: E402

HEADLINE = [
    "trial_summary",
    "trial_table",
    "valid_trials",
    "attach_sequence",
    "conditional_rates",
    "cell_means",
    "winsorize_z",
    "trial_within_cell",
    "split_half",
    "anova_contrast",
    "t_test_paired",
    "repair_markers",
    "recode_dual_markers",
    "marker_latencies",
    "break_index",
    "global_extreme_filter",
    "lateral_difference",
    "odd_even_summary",
    "correlation_by_cell",
    "item_score",
    "quantiles",
    "trial_window_join",
    "align_trial",
    "mask_blinks",
    "detect_saccades",
    "detect_fixations",
    "detect_dispersion",
    "trial_baseline",
    "baseline_validation",
    "first_dwell",
    "roi_dwell",
    "anova_first_dwell",
]


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds from building the plan to its last row; nothing but the rows is kept."""
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    first, later = {}, {}
    for name in names:
        first[name] = round(run(spark, name, sf_dir), 3)
        later[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(later.values()), 3),
                "unit": "sec",
                "queries": later,
                "first_run": first,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
