"""Access-log, latency, scan-log and storage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import derive
from ..functions import text as X
from ..operators import ranks, telemetry
from .common import access_log, ctes, scan_log

NOW = "2024-01-20 12:00:00"
SAFE = "coalesce(try_cast(upstream_time_s AS DOUBLE), 0)"


def getmap_top100(spark, sf):
    top = telemetry.newest_getmap(access_log(spark, sf), tie="event_id")
    return telemetry.with_numbers(top).select("event_id", "ts", "args", "upstream_time_s", "status", "size")


TOP100 = f"""WITH {ctes('fx_access_log')} SELECT event_id, ts, args, {SAFE} AS upstream_time_s, status::BIGINT AS status, size FROM fx_access_log
WHERE args LIKE '%GetMap%' ORDER BY ts DESC, event_id DESC LIMIT 100"""


def getmap_only(spark, sf):
    log = telemetry.with_numbers(telemetry.getmap_only(access_log(spark, sf)))
    return log.select("event_id", "upstream_time_s", X.latency_class("upstream_time_s").alias("class"), X.latency_text("upstream_time_s").alias("text"), X.tile_time_text(F.col("upstream_time_s") * 1000).alias("tile_text"))


GETMAP = f"""WITH {ctes('fx_access_log')}, g AS (SELECT event_id, {SAFE} AS t FROM fx_access_log WHERE args LIKE '%GetMap%')
SELECT event_id, t AS upstream_time_s, CASE WHEN t > 2 THEN 'slow' WHEN t < 0.5 THEN 'ok' ELSE '' END AS class,
 CASE WHEN t < 1 THEN printf('%.0f ms', t * 1000) ELSE printf('%.2f s', t) END AS text,
 CASE WHEN t * 1000 >= 1000 THEN printf('%.2f s', t) ELSE CAST(floor(t * 1000 + 0.5::DOUBLE) AS BIGINT) || ' ms' END AS tile_text FROM g"""


def getmap_report(spark, sf):
    # A day instead of an hour, since the events are about four minutes apart.
    return telemetry.getmap_report(access_log(spark, sf), NOW, window_hours=24, n=50, tie="event_id")


REPORT = f"""WITH {ctes('fx_access_log')}, w AS (SELECT * FROM fx_access_log WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}')
SELECT ts AS "timestamp", {SAFE} AS upstream_time_s, size, status::BIGINT AS status, args, least((SELECT count(*) FROM w WHERE args LIKE '%GetMap%'), 50) AS count,
 24 AS window_hours, (SELECT count(*) FROM w) AS scanned_records FROM w WHERE args LIKE '%GetMap%' ORDER BY ts DESC, event_id DESC LIMIT 50"""


def recent_rows(spark, sf):
    report = telemetry.getmap_report(access_log(spark, sf), NOW, window_hours=48, tie="event_id")
    return telemetry.recent_rows(report)


RECENT = f"""WITH {ctes('fx_access_log')}, w AS (SELECT *, {SAFE} AS t FROM fx_access_log WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '{NOW}'
 AND args LIKE '%GetMap%' ORDER BY ts DESC, event_id DESC LIMIT 20)
SELECT strftime(ts, '%H:%M:%S') AS time, printf('%.3fs', t) AS latency, CASE WHEN t > 2 THEN 'slow' WHEN t < 0.5 THEN 'ok' ELSE '' END AS latency_class, CAST(round(size / 1024::DOUBLE) AS BIGINT) || ' KB' AS size FROM w"""


def _samples(spark, sf):
    return telemetry.with_numbers(access_log(spark, sf))


def latency_block(spark, sf):
    block = telemetry.latency_block(_samples(spark, sf), by=("cache_status", "method"))
    return block.withColumn("mean", F.round("mean", 6))


def latency_block_all(spark, sf):
    return telemetry.latency_block(_samples(spark, sf)).withColumn("mean", F.round("mean", 6))


def _block(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    at = "max(CASE WHEN i = least(n - 1, CAST(floor(n * {p}::DOUBLE) AS BIGINT)) THEN t END) AS {name}"
    picks = ", ".join(at.format(p=p, name=name) for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return f"""WITH {ctes('fx_access_log')}, s AS (SELECT {lead}{SAFE} AS t FROM fx_access_log),
r AS (SELECT {lead}t, row_number() OVER ({part} ORDER BY t) - 1 AS i, count(*) OVER ({part}) AS n FROM s)
SELECT {lead}count(*) AS n, min(t) AS min, round(avg(t), 6) AS mean, {picks}, max(t) AS max FROM r {group}"""


def rank_percentile(spark, sf):
    """Nearest-rank percentiles of continuous values: order totals per priority, and prices per return flag with all signs."""
    o = derive(spark, sf, "SELECT o_orderpriority, o_totalprice FROM orders")
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    a = ranks.rank_percentiles(o, "o_totalprice", probs, ("o_orderpriority",)).withColumnRenamed("o_orderpriority", "g")
    li = derive(spark, sf, "SELECT l_returnflag, (l_extendedprice - 35000) * l_discount AS v FROM lineitem")
    b = ranks.rank_percentiles(li, "v", probs, ("l_returnflag",)).withColumnRenamed("l_returnflag", "g")
    return a.union(b)


def _ranked(group: str, value: str, table: str) -> str:
    picks = ", ".join(
        f"max(CASE WHEN i = least(n - 1, CAST(floor(n * {p}::DOUBLE) AS BIGINT)) THEN v END) AS {name}"
        for name, p in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0))
    )
    return f"""SELECT g, {picks} FROM (SELECT {group} AS g, {value} + 0.0::DOUBLE AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS i,
 count(*) OVER (PARTITION BY {group}) AS n FROM {table}) GROUP BY g"""


RANKS = _ranked("o_orderpriority", "o_totalprice", "orders") + " UNION ALL " + _ranked("l_returnflag", "((l_extendedprice - 35000) * l_discount)", "lineitem")


def benchmark_summary(spark, sf):
    runs = access_log(spark, sf).select(
        F.col("method").alias("run_id"), (X.safe_double("upstream_time_s") + F.col("size") / 1e6).alias("duration_s"), (F.col("event_id") % 10 != 0).alias("ok")
    )
    return telemetry.benchmark_summary(runs)


BENCHMARK = f"""WITH {ctes('fx_access_log')}, s AS (SELECT method AS run_id, {SAFE} + size / 1000000::DOUBLE AS d, event_id % 10 <> 0 AS ok FROM fx_access_log),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM s)
SELECT run_id, count(*) AS requests, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed, CAST(trunc(avg(d) * 1000) AS BIGINT) AS avg_ms,
 CAST(trunc(max(CASE WHEN i = CAST(floor(n * 0.5::DOUBLE) AS BIGINT) THEN d END) * 1000) AS BIGINT) AS p50_ms,
 CAST(trunc(max(CASE WHEN i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) THEN d END) * 1000) AS BIGINT) AS p95_ms FROM r GROUP BY run_id"""


def cache_status_counts(spark, sf):
    return telemetry.cache_status_counts(access_log(spark, sf), "status")


CACHE = f"WITH {ctes('fx_access_log')} SELECT status, cache_status, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes FROM fx_access_log GROUP BY status, cache_status"


def job_rollup(spark, sf):
    found = scan_log(spark, sf).select("job_id", F.lit(-1).cast("bigint").alias("line_no"), F.concat(F.lit("Discovered "), (F.col("job_id") + 5).cast("string"), F.lit(" GeoTIFFs under s3://b/p/")).alias("line")).distinct()
    lines = scan_log(spark, sf).union(found.where("job_id % 2 = 0"))
    exits = scan_log(spark, sf).select("job_id").distinct().where("job_id % 3 <> 0").select("job_id", (F.col("job_id") % 3 - 1).alias("exit_code"))
    return telemetry.job_status(telemetry.job_rollup(lines), exits)


ROLLUP = f"""WITH {ctes('fx_scan_log')}, l AS (SELECT job_id, arg_max(line_no, line_no) AS n FROM fx_scan_log GROUP BY job_id)
SELECT job_id, CASE WHEN job_id % 2 = 0 THEN job_id + 5 END AS discovered, n % 1000 AS scanned, n % 7 AS failures,
 CASE job_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'complete' ELSE 'failed' END AS status, CASE WHEN job_id % 3 = 2 THEN 'scanner exited with code 1' END AS error FROM l"""


def log_tail(spark, sf):
    return ranks.log_tail(scan_log(spark, sf), n=20)


LOG_TAIL = f"""WITH {ctes('fx_scan_log')} SELECT job_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) AS rn FROM fx_scan_log) WHERE rn <= 20"""


def last_samples(spark, sf):
    return ranks.last_n(access_log(spark, sf), [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "ts")


LAST_SAMPLES = f"WITH {ctes('fx_access_log')} SELECT event_id, ts FROM fx_access_log ORDER BY ts DESC, event_id DESC LIMIT 100"


def storage_stats(spark, sf):
    """Cached responses as a listing."""
    return telemetry.storage_stats(access_log(spark, sf).select(F.col("size").alias("length")))


STORAGE = f"""WITH {ctes('fx_access_log')} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, round(sum(size) / 1024 / 1024::DOUBLE, 2) AS megabytes FROM fx_access_log"""


def safe_numbers(spark, sf):
    """Text that is not a number counts as zero and stays in the data."""
    log = access_log(spark, sf)
    odd = F.when(F.col("event_id") % 11 == 0, F.lit("0.1, 0.2")).when(F.col("event_id") % 13 == 0, F.lit("")).otherwise(F.col("upstream_time_s"))
    return log.select("event_id", X.safe_double(odd).alias("seconds"), X.safe_int(F.when(F.col("event_id") % 17 > 0, F.col("size").cast("string")).otherwise(F.lit(""))).alias("size"))


SAFE_NUMBERS = f"""WITH {ctes('fx_access_log')} SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 0 ELSE {SAFE} END AS seconds,
 CASE WHEN event_id % 17 > 0 THEN size ELSE 0 END AS size FROM fx_access_log"""

QUERIES = {
    "getmap_top100": (getmap_top100, TOP100),
    "getmap_only": (getmap_only, GETMAP),
    "getmap_report": (getmap_report, REPORT),
    "recent_rows": (recent_rows, RECENT),
    "latency_block": (latency_block, _block("cache_status, method")),
    "latency_block_all": (latency_block_all, _block("")),
    "rank_percentile": (rank_percentile, RANKS),
    "benchmark_summary": (benchmark_summary, BENCHMARK),
    "cache_status_counts": (cache_status_counts, CACHE),
    "job_rollup": (job_rollup, ROLLUP),
    "log_tail": (log_tail, LOG_TAIL),
    "last_samples": (last_samples, LAST_SAMPLES),
    "storage_stats": (storage_stats, STORAGE),
    "safe_numbers": (safe_numbers, SAFE_NUMBERS),
}

