"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "c1_match_reversed_segments",
    "c4_within_distance",
    "c7_bbox_join",
    "c10_line_adjacency",
    "c11_overlap_area",
    "d2_tile_rollup",
    "e11_neighbor_runs",
    "e12_population_cut",
    "f1_with_dense_id",
    "i1_component_labels",
    "i2_forest_roots",
    "i13_subtree_sum",
    "upstream_population",
    "i14_branch_roots",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from terrajobs import plans

    spark.read.parquet(f"{sf_dir}/part.parquet").count()  # start the engine before timing
    took = {}
    for name in HEADLINE:
        began = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "territory_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
