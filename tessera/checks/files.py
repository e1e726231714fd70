"""Files written from the given tables and read again by the readers; ring predicates on every footprint."""

from __future__ import annotations

import struct
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import geometry as G
from ..operators import telemetry
from ..plans import refresh
from ..session import scratch_path
from ..sources import readers
from .common import access_log, ctes, footprints, lake, scan_log, unboxed
from .index import WKT_SQL, headers

# Send the function itself to the workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def headers_read(spark, sf):
    """Headers as JSON lines."""
    path = scratch_path(spark, "headers")
    headers(spark, sf).drop("id").write.json(path)
    back = readers.read_headers(spark, path, "json")
    return back.select("bucket", "key", "wkt", F.col("gt")[1].alias("pixel"), F.col("gt")[3].alias("top"), "width", "height", "bands", "data_type")


HEADERS_READ = f"""WITH {ctes('fx_headers')} SELECT 'imagery' AS bucket, key, {WKT_SQL} AS wkt, gt1 AS pixel, gt3 AS top, width, height, bands, data_type
FROM fx_headers""".replace("AS STRING", "AS VARCHAR")


def features_read(spark, sf):
    """Feature collections of at most 500 footprints a document; every second document has a name, the others their file's."""
    path = scratch_path(spark, "feature-documents")
    fp = footprints(spark, sf).withColumns({"ring": G.ring_from_bbox("bbox"), "doc": F.floor(F.col("id") / 500)})
    properties = F.struct(F.col("collection_id").alias("collection"), "key", F.col("id").cast("string").alias("file_name"), "epsg", F.lit(3).alias("bands"))
    outline = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    docs = fp.groupBy("doc").agg(F.collect_list(F.struct(properties.alias("properties"), outline.alias("geometry"))).alias("features"))
    name = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("layer-"), F.col("doc").cast("string")))
    docs.select("doc", F.to_json(F.struct(name.alias("name"), "features")).alias("value")).write.partitionBy("doc").text(path)
    back = readers.read_features(spark, path)
    named = F.col("layer").startswith("layer-")
    return back.select(
        F.col("file_name").cast("bigint").alias("id"), F.when(named, F.col("layer")).otherwise(F.substring("layer", 1, 5)).alias("layer"),
        "collection", "key", "epsg", "bands", F.size("ring").alias("points"), F.col("ring")[2]["x"].alias("xmax"), F.col("ring")[2]["y"].alias("ymax"),
    )


FEATURES_READ = f"""WITH {ctes('fx_footprints')} SELECT id, CASE WHEN (id // 500) % 2 = 0 THEN 'layer-' || (id // 500) ELSE 'part-' END AS layer,
 collection_id AS collection, key, CAST(epsg AS INT) AS epsg, 3 AS bands, 5 AS points, xmax, ymax FROM fx_footprints"""


def _log_files(spark, sf):
    path = scratch_path(spark, "access-log")
    log = access_log(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_id").cast("string").alias("remote_addr"), "method", "args",
        F.lit("/wms").alias("uri"), "status", "size", "upstream_time_s", "cache_status", F.lit(0.25).alias("total_time_s"),
    )
    log.write.json(path)
    return path


def access_log_read(spark, sf):
    """Both forms of the log, as a batch and as a stream over the same files."""
    path = _log_files(spark, sf)
    shown = ("remote_addr", "timestamp", "method", "status", "size", "upstream_time_s", "total_time_s")
    plain = readers.read_access_log(spark, path).select(F.lit("batch").alias("way"), *shown, F.col("args").alias("detail"))
    out = scratch_path(spark, "access-log-stream")
    stream = readers.stream_access_log(spark, path, cache=True, maxFilesPerTrigger="4").select(F.lit("stream").alias("way"), *shown, F.col("cache_status").alias("detail"))
    query = stream.writeStream.option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    both = plain.unionByName(spark.read.schema(stream.schema).parquet(out))
    return telemetry.with_numbers(both).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


ACCESS_LOG_READ = f"""WITH {ctes('fx_access_log')}, l AS (SELECT event_id::VARCHAR AS remote_addr, date_trunc('second', ts) AS "timestamp", method, args, status::BIGINT AS status, size,
 coalesce(try_cast(upstream_time_s AS DOUBLE), 0) AS upstream_time_s, 0.25::DOUBLE AS total_time_s, cache_status FROM fx_access_log)
SELECT 'batch' AS way, * EXCLUDE (args, cache_status), args AS detail FROM l UNION ALL SELECT 'stream', * EXCLUDE (args, cache_status), cache_status FROM l"""


def scan_log_read(spark, sf):
    """Scanner output of one folder a job, one job for every 64 users."""
    path = scratch_path(spark, "scan-log")
    lines = scan_log(spark, sf).select(
        F.concat(F.lit("job-"), F.floor(F.col("job_id") / 64).cast("string")).alias("job_id"), F.concat_ws("\t", F.col("line_no").cast("string"), "line").alias("value")
    )
    # a chatty job is dealt to several tasks
    lines.repartition("job_id", F.xxhash64("value") % 8).write.partitionBy("job_id").text(path)
    return telemetry.job_rollup(readers.read_scan_log(spark, path))


SCAN_LOG_READ = f"""WITH {ctes('fx_scan_log')} SELECT 'job-' || (job_id // 64) AS job_id, NULL::BIGINT AS discovered,
 arg_max(regexp_extract(line, 'Scanned ([0-9]+)/', 1)::BIGINT, line_no) AS scanned, arg_max(regexp_extract(line, 'failures=([0-9]+)', 1)::BIGINT, line_no) AS failures
FROM fx_scan_log GROUP BY 1"""


def stored_bytes(spark, sf):
    """Size of written files by their listing: lines of known length."""
    path = scratch_path(spark, "stored")
    scan_log(spark, sf).select(F.col("line").alias("value")).write.text(path)
    return telemetry.storage_stats(readers.storage_listing(spark, path)).select("bytes", "megabytes")


STORED_BYTES = f"""WITH {ctes('fx_scan_log')}, s AS (SELECT CAST(sum(length(line) + 1) AS BIGINT) AS bytes FROM fx_scan_log)
SELECT bytes, round(bytes / 1024 / 1024, 2) AS megabytes FROM s"""


@F.pandas_udf(BinaryType())
def _rectangle(xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    """Every second rectangle with the largest byte first, and as a multi-polygon."""
    out = []
    for i, (a, b, c, d) in enumerate(zip(xmin, ymin, xmax, ymax)):
        order, mark = ("<", 1) if i % 2 else (">", 0)
        ring = struct.pack(order + "BIII10d", mark, 3, 1, 5, a, b, c, b, c, d, a, d, a, b)
        out.append(ring if i % 3 else struct.pack(order + "BII", mark, 6, 1) + ring)
    return pd.Series(out)


def lake_geometry(spark, sf):
    """A lake with binary geometry only: staged with boxes of its own."""
    rows = lake(spark, sf)
    edges = [F.col(f"bbox.{f}") for f in G.BBOX_FIELDS]
    shapes = rows.withColumn("geometry", F.when(F.col("id") % 13 != 0, _rectangle(*edges))).drop("bbox")
    staged = refresh.staged_rows(shapes, "http://localhost:8001")
    return unboxed(staged.select("id", "tile_srs", "bbox"))


LAKE_GEOMETRY = f"""WITH {ctes('fx_lake')} SELECT id, 'EPSG:' || proj_epsg::VARCHAR AS tile_srs, CASE WHEN id % 13 <> 0 THEN xmin END AS xmin, CASE WHEN id % 13 <> 0 THEN ymin END AS ymin,
 CASE WHEN id % 13 <> 0 THEN xmax END AS xmax, CASE WHEN id % 13 <> 0 THEN ymax END AS ymax FROM fx_lake"""


CENTRE, RADIUS = (-9480000.0, 4510000.0), 9000.0


def ring_predicates(spark, sf):
    """Footprint rings against a diamond, which no box test decides."""
    (x, y), r = CENTRE, RADIUS
    corners = ((x + r, y), (x, y + r), (x - r, y), (x, y - r), (x + r, y))
    diamond = F.array(*[G.point(F.lit(a), F.lit(b)) for a, b in corners])
    rows = footprints(spark, sf).select("id", G.ring_from_bbox("bbox").alias("ring"), diamond.alias("diamond"))
    return rows.select("id", G.ring_intersects("ring", "diamond").alias("meets"), G.ring_contains("diamond", "ring").alias("within"))


# A box meets a diamond when its nearest point is within the radius by the sum of axes, and lies in it when its farthest is.
RING_PREDICATES = f"""WITH {ctes('fx_footprints')}
SELECT id, greatest(xmin - ({CENTRE[0]}), ({CENTRE[0]}) - xmax, 0) + greatest(ymin - {CENTRE[1]}, {CENTRE[1]} - ymax, 0) <= {RADIUS} AS meets,
 greatest(abs(xmin - ({CENTRE[0]})), abs(xmax - ({CENTRE[0]}))) + greatest(abs(ymin - {CENTRE[1]}), abs(ymax - {CENTRE[1]})) <= {RADIUS} AS within FROM fx_footprints"""


QUERIES = {
    "headers_read": (headers_read, HEADERS_READ),
    "features_read": (features_read, FEATURES_READ),
    "access_log_read": (access_log_read, ACCESS_LOG_READ),
    "scan_log_read": (scan_log_read, SCAN_LOG_READ),
    "stored_bytes": (stored_bytes, STORED_BYTES),
    "lake_geometry": (lake_geometry, LAKE_GEOMETRY),
    "ring_predicates": (ring_predicates, RING_PREDICATES),
}
