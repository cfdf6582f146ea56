"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1).  BENCH_CPUS: cores
(default all).  BENCH_QUERIES: comma-separated names instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from factfade.plans import all_queries

HEADLINE = (
    "list_entities", "entity_graph", "full_event", "observations_by_id", "event_counts",
    "recall", "conflict_hints", "remember_batch", "relate", "forget_entities",
    "propose_duplicates", "apply_duplicates", "semantic_candidates", "semantic_clusters",
    "usage_by_client", "hint_action_ratio", "entity_transitions", "sanitize_args",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("factfade-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # The first job pays for starting the engine, not for a query.
    queries["active_events"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
