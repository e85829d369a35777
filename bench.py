"""Time the headline queries and print one JSON line.

Each query runs once unmeasured, so that the JVM is warm, and then once measured. All rows
of its result are produced and dropped.

    BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from corpusprov import plans  # noqa: E402

HEADLINE = [
    "kl_all_pairs", "kl_all_pairs_hosts", "kl_all_pairs_unmerged", "kl_divergence",
    "kl_divergence_hosts", "url_domain_table", "extract_domain_sql", "domain_counts_lines",
    "domain_counts_unified", "host_counts_merged", "combined_host_counts", "domain_share",
    "top_domains", "top10_vs_median", "threshold_and_match", "match_fraction_counts",
    "snapshot_stats", "distinct_domains", "gini_by_dataset", "lorenz_curve", "top_share_pct",
    "size_bucket_pct", "log_histogram", "path_facets", "section_share_delta", "top_sections",
    "year_density", "manifest_grep", "chunk_lines", "size_batches", "dedupe_first",
    "text_mentions", "text_mentions_anchored", "mentions_depth1", "language_share", "label_metrics", "parse_label_response",
    "stratified_sample", "streamed_domain_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(plans.queries())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = plans.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
