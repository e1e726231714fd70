"""Headline queries, timed on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once untimed (class loading, code generation) and then ``BENCH_RUNS`` times; the best time
counts. ``naive`` holds the plain Spark form of some of them on the same data: a theta join instead of the
grid join, an unsorted index instead of the staged one, one sort per group instead of histograms.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import Window as W  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.checks import registry  # noqa: E402
from tessera.checks.common import access_log, footprints  # noqa: E402
from tessera.functions import geometry as G  # noqa: E402
from tessera.functions import tiles as T  # noqa: E402
from tessera.operators import telemetry  # noqa: E402
from tessera.plans import tile_report  # noqa: E402
from tessera.session import build_session  # noqa: E402

HEADLINE = (
    "tile_footprint_join", "tile_hits", "tile_coverage", "classify_tiles", "classify_tiles_by_collection",
    "classify_tiles_polygons", "sample_tiles", "tile_read_plan", "bbox_window", "staged_window",
    "footprint_from_header", "reproject_rings", "collection_facts", "extent_by_epsg", "tile_index_table",
    "index_summary", "published_generation", "catalog_upsert", "getmap_top100", "latency_block",
    "rank_percentile", "benchmark_summary", "job_rollup", "cache_status_counts",
)


def naive_tile_hits(spark, sf):
    fp = footprints(spark, sf)
    tiles = tile_report.area_tiles(fp, 15).withColumn("tile_bbox", T.tile_bbox("x", "y", "z"))
    hits = tiles.join(fp.select("id", "bbox"), G.bbox_intersects("tile_bbox", "bbox"))
    return hits.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.bool_or(G.bbox_contains("bbox", "tile_bbox")).alias("inside"))


def grid_tile_hits(spark, sf):
    from tessera.operators import spatial

    fp = footprints(spark, sf)
    return spatial.tile_hits(tile_report.area_tiles(fp, 15), fp, 15)


def naive_percentiles(spark, sf):
    log = telemetry.with_numbers(access_log(spark, sf))
    w = W.partitionBy("cache_status", "method")
    ranked = log.select("cache_status", "method", "upstream_time_s", (F.row_number().over(w.orderBy("upstream_time_s")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    pick = lambda p: F.max(F.when(F.col("i") == F.floor(F.col("n") * p), F.col("upstream_time_s")))
    return ranked.groupBy("cache_status", "method").agg(pick(0.5).alias("median"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))


NAIVE = {"tile_hits_z15_theta_join": naive_tile_hits, "tile_hits_z15_grid_join": grid_tile_hits, "latency_block_group_sort": naive_percentiles}


def timed(spark, query, sf, runs):
    best = None
    for i in range(runs + 1):
        start = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        if i:
            best = took if best is None else min(best, took)
    return round(best, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry()
    times = {name: timed(spark, found[name][0], sf, runs) for name in HEADLINE}
    naive = {name: timed(spark, query, sf, runs) for name, query in NAIVE.items()}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "naive": naive, "sf": os.path.basename(sf).removeprefix("sf"), "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
