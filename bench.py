"""Time the headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list),
BENCH_MEM (default 16g).  Every result is written to a no-op sink, so whole results are computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from refloom.plans.runtime import session_tuning  # noqa: E402
from refloom.workload import load  # noqa: E402

HEADLINE = (
    "closure_by_type", "blast_radius", "degrees", "deps_top", "node_table", "neighborhood", "dep_tree", "dep_tree_pruned", "forbidden_paths",
    "cascade_orphans", "container_edges", "container_rollup", "cycle_groups", "duplication_by_priority", "summary", "size_map", "unused_documents",
    "dangling_links", "utilization", "longest_prefix_container", "transition_graph", "exact_duplicates", "canonical_json_dups", "shared_names",
    "signature_confirm", "resolve_names", "fuzzy_search", "resolved_edges", "section_records", "rewrite_refs", "doc_validation", "violations",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("refloom-bench")
    builder = builder.config("spark.driver.memory", os.environ.get("BENCH_MEM", "16g")).config("spark.ui.showConsoleProgress", "false")
    if not os.environ.get("SPARK_CHECKPOINT_DIR"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        builder = builder.config("spark.checkpoint.dir", os.environ["SPARK_CHECKPOINT_DIR"])
    spark = session_tuning(builder, cpus).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": Path(sf_dir).name, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
