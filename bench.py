"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with the median of warm runs in seconds."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from meshset import queries
from meshset.engine import Engine
from meshset.sources import sample

sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
runs = int(os.environ.get("BENCH_RUNS", "3"))
NAMES = ["flagship", "expand_hosts", "all_clusters", "orphans", "nearest_common_ancestor", "bfs_first_key", "multiset_union_max", "set_difference", "scd_build", "topo_levels", "learner_quorum", "node_tags_map"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("bench")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8")).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cached = Engine(sample.load(spark, sf_dir).cache())
    cases = {n: (lambda f=queries.QUERIES[n]: f(spark, sf_dir)) for n in NAMES}
    cases["membership_cached"] = lambda: cached.plan("%%AFRICA,&%%AFRICA")
    took = {}
    for name, make in cases.items():
        each = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - start)
        took[name] = round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "total of the headline queries' median warm times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
