"""Times the headline queries once each, after a warm-up, and prints one JSON line."""

import json
import os
import time
import warnings

from pyspark.sql import SparkSession

from quillon.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("flat_topk_dot", "flat_topk_cosine", "filtered_pre", "search_by_key", "sharded_merge", "keyword_topk", "hybrid_weighted", "hybrid_rrf", "latest_wins", "ttl_live", "sq8_two_stage", "ivf_probe_topk", "ivf_sq8_topk", "duplicate_pairs", "percentile_nearest_rank")


def main() -> None:
    warnings.simplefilter("ignore")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["flat_topk_dot"][0](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name][0](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
