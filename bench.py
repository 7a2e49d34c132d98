"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query is run once to warm up and RUNS times for the figure, the median. Results go to the noop sink, so all
rows and columns are made and none is kept.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from helixloom.queries import QUERIES

HEADLINE = (
    "kmer_extract", "kmer_count", "window_tile", "window_fold", "window_fold_slide", "eff_length", "find_ibs", "ibs_summary", "info_stats", "cohort_validate", "increase_window",
    "attributes_wide", "genotype_table", "plink_ped", "site_summary", "kinship", "interval_merge", "interval_contained", "gtf_tree", "spliced_seq", "screen_transcripts", "compare_ibs",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
