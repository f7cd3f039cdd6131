"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attestry.plans.catalog import QUERIES  # noqa: E402
from attestry.session import build_session  # noqa: E402

HEADLINE = [
    "log_ratio_annual_regional", "log_ratio_grains", "balance_profile", "balance_rank", "unisex_dataset",
    "international_unisex", "pairwise_rank_summary", "balance_angle", "biased_strata", "total_distribution",
    "longevity", "top_per_area", "names_australia", "names_combined", "rating_data", "population_vs_ratings",
    "density2d", "assemble", "percent_subject_by_image_and_gender", "poisson_deviances", "logistic_coefficients",
    "normalize_name",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start the workers and the code generator before the clock
    QUERIES["corpus_profile"](spark, sf_dir).collect()
    only = sys.argv[1:] or HEADLINE
    times = {}
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
