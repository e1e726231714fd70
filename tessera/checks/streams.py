"""Streaming queries, run to completion over the given events and read from where they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import FIXTURES, table
from ..functions import text as X
from ..session import scratch_path
from ..sources import readers
from ..streaming import index as SI
from ..streaming import telemetry as ST
from .common import ctes
from .telemetry import SAFE


def _stream(spark: SparkSession, sf: str, name: str, source: str = "events") -> DataFrame:
    """A fixture over the events as a stream of their file."""
    schema = table(spark, sf, source).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{source}.parquet").parquet(sf)
    if source == "events":
        raw = raw.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant
    return spark.sql(FIXTURES[name].replace(f"FROM {source}", "FROM {raw}"), raw=raw)


def _wall_clock(df: DataFrame, *columns: str) -> DataFrame:
    """Instants back as the zone-less timestamps the events came with."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def stream_getmap_windows(spark, sf):
    path = scratch_path(spark, "windows")
    windows = ST.getmap_windows(_stream(spark, sf, "fx_access_log"), length="1 day", slide="6 hours")
    state = ST.BatchedState(path, "window_start timestamp, window_end timestamp, requests bigint, errors bigint, mean_s double, max_s double")
    writer = windows.writeStream.outputMode("complete").foreachBatch(lambda b, i: state.save(b, i))
    _finish(writer.option("checkpointLocation", path + "-checkpoint"))
    return _wall_clock(state.current(spark), "window_start", "window_end").withColumn("mean_s", F.round("mean_s", 6))


WINDOWS = f"""WITH {ctes('fx_access_log')}, g AS (SELECT *, {SAFE} AS t FROM fx_access_log WHERE args LIKE '%GetMap%'),
k AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b, unnest(generate_series(0, 3)) AS back FROM g),
w AS (SELECT *, b - back * INTERVAL 6 HOUR AS window_start FROM k)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors, round(avg(t), 6) AS mean_s, max(t) AS max_s
FROM w GROUP BY window_start"""


def stream_cache_status(spark, sf):
    path = scratch_path(spark, "cache")
    counts = ST.cache_status_windows(_stream(spark, sf, "fx_access_log"), length="1 day")
    store = ST.ChangedRows(path, ["window_start", "cache_status"], "window_start timestamp, cache_status string, requests bigint, bytes bigint")
    writer = counts.writeStream.outputMode("update").foreachBatch(store.save)
    _finish(writer.option("checkpointLocation", path + "-checkpoint"))
    return _wall_clock(store.current(spark), "window_start")


CACHE_WINDOWS = f"""WITH {ctes('fx_access_log')} SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, cache_status, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes
FROM fx_access_log GROUP BY 1, 2"""


def stream_scan_progress(spark, sf):
    path = scratch_path(spark, "progress")
    state = ST.BatchedState(path, "job_id bigint, discovered bigint, scanned bigint, failures bigint")
    _finish(ST.rollup_to(_stream(spark, sf, "fx_scan_log"), state, path + "-checkpoint"))
    return state.current(spark)


PROGRESS = f"""WITH {ctes('fx_scan_log')}, l AS (SELECT job_id, max(line_no) AS n FROM fx_scan_log GROUP BY job_id)
SELECT job_id, NULL::BIGINT AS discovered, n % 1000 AS scanned, n % 7 AS failures FROM l"""


def stream_last_samples(spark, sf):
    path = scratch_path(spark, "samples")
    state = ST.BatchedState(path, ST.SAMPLE_SCHEMA)
    _finish(ST.last_samples(_stream(spark, sf, "fx_access_log"), state, path + "-checkpoint"))
    return _wall_clock(state.current(spark), "ts")


SAMPLES = f"""WITH {ctes('fx_access_log')} SELECT event_id, ts, {SAFE} AS upstream_time_s FROM fx_access_log WHERE args LIKE '%GetMap%' ORDER BY ts DESC, event_id DESC LIMIT 100"""


def _parts_by_time(spark, sf, n=4):
    """The events as n files in the order of time, written one after another; a stream takes one a micro-batch."""
    path = scratch_path(spark, "events-by-time")
    events = table(spark, sf, "events")
    first, last = events.select(F.unix_seconds(F.min("ts").cast("timestamp")), F.unix_seconds(F.max("ts").cast("timestamp"))).first()
    if first is None:
        first = last = 0
    step = (last - first) // n + 1
    part = F.coalesce(F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - first) / step), F.lit(0))
    for i in range(n):
        events.where(part == i).coalesce(1).write.mode("append").parquet(path)
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(FIXTURES["fx_access_log"].replace("FROM events", "FROM {raw}"), raw=raw)


def stream_trailing_latency(spark, sf):
    """Exact figures of every trailing hour, by quarters of an hour, from several micro-batches in update mode."""
    path = scratch_path(spark, "panes")
    _finish(ST.panes_to(_parts_by_time(spark, sf), path, path + "-checkpoint", slide="15 minutes"))
    found = ST.trailing_latency(ST.pane_store(path).current(spark), 900, 4)
    return _wall_clock(found, "window_start", "window_end").withColumn("mean", F.round("mean", 6))


def _trailing_sql() -> str:
    picks = ", ".join(f"max(CASE WHEN i = least(n - 1, CAST(floor(n * {p}::DOUBLE) AS BIGINT)) THEN t END) AS {name}" for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return f"""WITH {ctes('fx_access_log')}, g AS (SELECT ts, {SAFE} AS t FROM fx_access_log WHERE args LIKE '%GetMap%'),
k AS (SELECT t, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS b, unnest(generate_series(0, 3)) AS back FROM g),
r AS (SELECT t, b - back * INTERVAL 15 MINUTE AS window_start FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY window_start) AS n FROM r)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n, min(t) AS min, round(avg(t), 6) AS mean, {picks}, max(t) AS max FROM o GROUP BY window_start"""


def stream_latency(spark, sf):
    """Exact percentiles of every micro-batch."""
    path = scratch_path(spark, "latency")
    _finish(ST.latency_percentiles(_stream(spark, sf, "fx_access_log"), path, path + "-checkpoint"))
    block = spark.read.option("basePath", path).parquet(path)
    return block.select("n", "min", F.round("mean", 6).alias("mean"), "median", "p95", "p99", "max")


def _latency_sql() -> str:
    picks = ", ".join(
        f"max(CASE WHEN i = CAST(floor(n * {p}::DOUBLE) AS BIGINT) THEN t END) AS {name}" for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))
    )
    return f"""WITH {ctes('fx_access_log')}, s AS (SELECT {SAFE} AS t FROM fx_access_log WHERE args LIKE '%GetMap%'),
r AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT count(*) AS n, min(t) AS min, round(avg(t), 6) AS mean, {picks}, max(t) AS max FROM r"""


def _loaded(spark, fp):
    path = scratch_path(spark, "streamed-index")
    rows = fp.select("collection_id", F.concat(F.lit("/v/"), F.col("key")).alias("location"), X.file_name("key").alias("file_name"), "key", F.lit(3857).alias("native_epsg"), F.col("id").alias("seq"), F.lit(1).alias("load"))
    _finish(SI.replace_collections(rows, path, path + "-checkpoint"))
    return readers.read_index(spark, path).select("collection_id", "location", "file_name", "native_epsg")


def stream_index_load(spark, sf):
    """Footprint rows arriving as a stream replace their collections."""
    return _loaded(spark, _stream(spark, sf, "fx_footprints", "part"))


def stream_index_load_split(spark, sf):
    """The same rows from several files, one file a micro-batch, so that every collection is spread over batches."""
    source = scratch_path(spark, "split-part")
    table(spark, sf, "part").repartition(3).write.parquet(source)
    raw = spark.readStream.schema(table(spark, sf, "part").schema).option("maxFilesPerTrigger", 1).parquet(source)
    return _loaded(spark, spark.sql(FIXTURES["fx_footprints"].replace("FROM part", "FROM {raw}"), raw=raw))


STREAMED_INDEX = f"""WITH {ctes('fx_footprints')} SELECT DISTINCT collection_id, '/v/' || key AS location, regexp_extract(key, '[^/]*$') AS file_name, 3857 AS native_epsg FROM fx_footprints"""

QUERIES = {
    "stream_getmap_windows": (stream_getmap_windows, WINDOWS),
    "stream_cache_status": (stream_cache_status, CACHE_WINDOWS),
    "stream_scan_progress": (stream_scan_progress, PROGRESS),
    "stream_last_samples": (stream_last_samples, SAMPLES),
    "stream_trailing_latency": (stream_trailing_latency, _trailing_sql()),
    "stream_latency": (stream_latency, _latency_sql()),
    "stream_index_load": (stream_index_load, STREAMED_INDEX),
    "stream_index_load_split": (stream_index_load_split, STREAMED_INDEX),
}
