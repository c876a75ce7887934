"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local threads,
BENCH_QUERIES an optional comma-separated subset.  Each query runs once to warm up code
generation on the smallest tables present, then once on the real ones, every row computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "split_sizes",                  # row counts from one column
    "encoded_rows",                 # load + split + fit vocabularies + encode all splits
    "dense_features",               # ten train-only features on all rows
    "ranking_report_random",        # metric engine alone
    "ranking_report_popularity",    # fit + score + report
    "ranking_report_by_split",
    "per_user_primary",
    "topk_per_user",
    "quantile_edges",
    "pair_sample",
    "split_leak_rows",
    "duplicate_pairs",
    "paired_bootstrap",             # 500 resamples of three paired candidates
    "poisson_bootstrap",
    "prediction_check_violations",
    "gate_verdict",                 # whole-text rule scan
    "fm_score_relational",
    "fm_pointwise",                 # training to early stopping + scoring
]


def main() -> None:
    from pyspark.sql import SparkSession

    from rankspark.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    warm = str(Path(sf_dir).parent / "sf0.001")
    times: dict[str, float] = {}
    for name in names:
        if os.path.isdir(warm):
            queries[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:32s} {times[name]:8.2f}s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
