"""Reports over access logs, load samples, scan logs and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import ranks


def getmap_only(log: DataFrame) -> DataFrame:
    """Map requests only; the match is case-sensitive."""
    return log.where(F.col("args").contains("GetMap"))


def with_numbers(log: DataFrame) -> DataFrame:
    """Logged text turned into numbers; anything that is not a number counts as zero and stays."""
    return log.withColumns(
        {
            "upstream_time_s": X.safe_double("upstream_time_s"),
            "size": X.safe_int("size"),
            "status": X.safe_int("status"),
        }
    )


def newest_getmap(log: DataFrame, n: int = 100, time: str = "ts", tie: str | None = None) -> DataFrame:
    """The ``n`` newest map requests, as a top-k."""
    order = [F.col(time).desc()] + ([F.col(tie).desc()] if tie else [])
    return getmap_only(log).orderBy(*order).limit(n)


def getmap_report(
    log: DataFrame, now, window_hours: int = 1, n: int = 100, time: str = "ts", tie: str | None = None
) -> DataFrame:
    """Newest map requests of the trailing window with the number shown, the window and the records scanned."""
    end = F.lit(now).cast("timestamp")
    recent = log.where((F.col(time) > end - F.expr(f"INTERVAL {window_hours} HOURS")) & (F.col(time) <= end))
    scanned = recent.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = newest_getmap(recent, n, time, tie)
    shown = F.least(getmap_only(recent).agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(n).cast("bigint"))
    return with_numbers(top).select(
        F.col(time).alias("timestamp"),
        "upstream_time_s",
        "size",
        "status",
        "args",
        shown.alias("count"),
        F.lit(window_hours).alias("window_hours"),
        scanned.alias("scanned_records"),
    )


def recent_rows(report: DataFrame, n: int = 20) -> DataFrame:
    """The first rows of a report as displayed: time of day, seconds with class, kilobytes."""
    t = F.col("upstream_time_s")
    return (
        report.orderBy(F.col("timestamp").desc()).limit(n)
        .select(
            F.date_format("timestamp", "HH:mm:ss").alias("time"),
            F.format_string("%.3fs", t).alias("latency"),
            X.latency_class(t).alias("latency_class"),
            F.format_string("%.0f KB", F.col("size") / 1024.0).alias("size"),
        )
    )


def latency_block(samples: DataFrame, value: str = "upstream_time_s", by: tuple[str, ...] = ()) -> DataFrame:
    """n, min, mean, median, p95, p99 and max; percentiles are exact nearest ranks."""
    basic = samples.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
    )
    tail = ranks.rank_percentiles(samples, value, {"median": 0.5, "p95": 0.95, "p99": 0.99}, by)
    return _beside(basic, tail, by).select(*by, "n", "min", "mean", "median", "p95", "p99", "max")


def benchmark_summary(samples: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Requests, success, failed and avg/p50/p95 in whole milliseconds (cut, not rounded); zeros when empty."""
    basic = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("ok")).alias("success"),
        F.avg("duration_s").alias("__avg"),
    )
    tail = ranks.rank_percentiles(samples, "duration_s", {"__p50": 0.5, "__p95": 0.95}, by)

    def millis(c: str):
        return F.coalesce((F.col(c) * 1000).cast("bigint"), F.lit(0).cast("bigint"))

    return _beside(basic, tail, by).select(
        *by,
        "requests",
        "success",
        (F.col("requests") - F.col("success")).alias("failed"),
        millis("__avg").alias("avg_ms"),
        millis("__p50").alias("p50_ms"),
        millis("__p95").alias("p95_ms"),
    )


def _beside(basic: DataFrame, tail: DataFrame, by: tuple[str, ...]) -> DataFrame:
    if by:
        return basic.join(tail, list(by), "left")
    # Two one-row results.
    return basic.withColumn("__one", F.lit(1)).join(F.broadcast(tail.withColumn("__one", F.lit(1))), "__one", "left").drop("__one")


def cache_status_counts(log: DataFrame, *by) -> DataFrame:
    return log.groupBy(*by, "cache_status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("size").alias("bytes")
    )


def storage_stats(files: DataFrame, length: str = "length") -> DataFrame:
    """Files, bytes and megabytes (two digits) of a listing."""
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(length), F.lit(0).cast("bigint")).alias("bytes")
    ).withColumn("megabytes", F.round(F.col("bytes") / 1024 / 1024, 2))


def parse_scan_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Numbers found in scanner output: ``discovered``, ``scanned``, ``failures`` (null where not in the line)."""
    return lines.withColumns(
        {
            "discovered": X.extract(line, X.DISCOVERED_LINE, 1).cast("bigint"),
            "scanned": X.extract(line, X.PROGRESS_LINE, 1).cast("bigint"),
            "failures": X.extract(line, X.PROGRESS_LINE, 3).cast("bigint"),
        }
    )


def job_rollup(lines: DataFrame, job: str = "job_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Latest counts per job. ``max_by`` keeps one value per job and task, so a chatty job costs nothing extra."""
    parsed = parse_scan_lines(lines, line)

    def latest(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(line_no)))

    return parsed.groupBy(job).agg(
        latest("discovered").alias("discovered"),
        F.coalesce(latest("scanned"), F.lit(0).cast("bigint")).alias("scanned"),
        F.coalesce(latest("failures"), F.lit(0).cast("bigint")).alias("failures"),
    )


def job_status(rollup: DataFrame, exits: DataFrame, job: str = "job_id") -> DataFrame:
    """Final state per job from its exit code (null while running)."""
    code = F.col("exit_code")
    return rollup.join(exits, job, "left").select(
        *rollup.columns,
        F.when(code.isNull(), F.lit("running")).when(code == 0, F.lit("complete")).otherwise(F.lit("failed")).alias("status"),
        F.when(code != 0, F.concat(F.lit("scanner exited with code "), code.cast("string"))).alias("error"),
    )
