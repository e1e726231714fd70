"""Streaming reports over access logs, cache logs and scan logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as X
from ..operators import ranks, telemetry
from ..sources import files


def getmap_windows(log: DataFrame, time: str = "ts", length: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, failures and mean latency of map requests over a trailing window."""
    seconds = X.safe_double("upstream_time_s")
    return (
        telemetry.getmap_only(log)
        .withWatermark(time, late)
        .groupBy(F.window(time, length, slide))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(X.safe_int("status") >= 500).alias("errors"),
            F.avg(seconds).alias("mean_s"),
            F.max(seconds).alias("max_s"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests", "errors", "mean_s", "max_s")
    )


def cache_status_windows(log: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and bytes per cache status and tumbling window."""
    counted = telemetry.cache_status_counts(log.withWatermark(time, late), F.window(time, length))
    return counted.select(F.col("window.start").alias("window_start"), "cache_status", "requests", "bytes")


def scan_progress(lines: DataFrame) -> DataFrame:
    """Latest counts per job; run in update mode."""
    return telemetry.job_rollup(lines)


def write_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Stream into Parquet (append) with the given checkpoint."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)


class BatchedState:
    """A small table kept between micro-batches as one folder per batch.

    Batch n reads the newest state older than n and writes its own folder, so a batch that is repeated
    after a failure gives the same result.
    """

    def __init__(self, path: str, schema: str):
        self.path = path.rstrip("/")
        self.schema = schema

    def _batches(self, spark: SparkSession) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in files.children(spark, self.path) if n.startswith("batch="))

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        older = [b for b in self._batches(spark) if b < batch]
        if not older:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch={older[-1]}")

    def save(self, df: DataFrame, batch: int, keep: int = 2) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        spark = df.sparkSession
        for old in self._batches(spark)[:-keep]:
            files.remove(spark, f"{self.path}/batch={old}")

    def current(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, 2**62)


class ChangedRows:
    """What an update-mode stream gives out, one folder a micro-batch; the newest row of a key counts.

    A micro-batch that runs again overwrites its folder. ``compact`` folds the folders into one.
    """

    def __init__(self, path: str, keys: list[str], schema: str):
        self.path, self.keys, self.schema = path.rstrip("/"), keys, f"{schema}, batch bigint"

    def save(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def current(self, spark: SparkSession) -> DataFrame:
        if not files.children(spark, self.path):
            return spark.createDataFrame([], self.schema).drop("batch")
        rows = spark.read.schema(self.schema).parquet(self.path)
        return ranks.keep_first(rows, self.keys, [F.col("batch").desc()]).drop("batch")

    def compact(self, spark: SparkSession) -> None:
        """Fold all folders into that of the newest batch. Not while the stream writes."""
        names = sorted((n for n in files.children(spark, self.path) if n.startswith("batch=")), key=lambda n: int(n[6:]))
        if len(names) > 1:
            folded = f"{self.path}/_{names[-1]}"
            self.current(spark).write.mode("overwrite").parquet(folded)
            files.remove(spark, f"{self.path}/{names[-1]}")
            files.move(spark, folded, f"{self.path}/{names[-1]}")
            for name in names[:-1]:
                files.remove(spark, f"{self.path}/{name}")


PANE_SCHEMA = "pane timestamp, upstream_time_s double, n bigint"


def latency_panes(log: DataFrame, time: str = "ts", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """How often each latency occurs in each pane of event time; run in update mode.

    The state has one count for each distinct latency of a pane (milliseconds: few), however many requests there are, and
    the watermark frees a pane when no request can fall into it any more.
    """
    seconds = X.safe_double("upstream_time_s")
    counted = telemetry.getmap_only(log).withWatermark(time, late).groupBy(F.window(time, slide), seconds.alias("upstream_time_s")).count()
    return counted.select(F.col("window.start").alias("pane"), "upstream_time_s", F.col("count").alias("n"))


def panes_to(log: DataFrame, path: str, checkpoint: str, **windows: str) -> DataStreamWriter:
    store = pane_store(path)
    return latency_panes(log, **windows).writeStream.outputMode("update").foreachBatch(store.save).option("checkpointLocation", checkpoint)


def pane_store(path: str) -> ChangedRows:
    return ChangedRows(path, ["pane", "upstream_time_s"], PANE_SCHEMA)


def trailing_latency(panes: DataFrame, slide_s: int = 300, panes_per_window: int = 12) -> DataFrame:
    """Exact n, min, mean, median, p95, p99 and max of every window of so many panes, as nearest ranks.

    Histograms of panes add up to those of windows; a window is ranked over its distinct values.
    """
    back = F.explode(F.sequence(F.lit(0), F.lit(panes_per_window - 1)))
    each = panes.select("*", back.alias("back")).select(
        F.timestamp_seconds(F.unix_seconds("pane") - F.col("back") * slide_s).alias("window_start"), "upstream_time_s", "n"
    )
    histogram = each.groupBy("window_start", "upstream_time_s").agg(F.sum("n").alias("n"))
    group = W.partitionBy("window_start")
    counted = histogram.withColumn("to", F.sum("n").over(group.orderBy("upstream_time_s"))).withColumn("total", F.sum("n").over(group))

    def at(p: float, name: str):
        rank = F.least(F.floor(F.col("total") * F.lit(p)), F.col("total") - 1)
        here = (F.col("to") - F.col("n") <= rank) & (rank < F.col("to"))
        return F.max(F.when(here, F.col("upstream_time_s"))).alias(name)

    length = slide_s * panes_per_window
    found = counted.groupBy("window_start").agg(
        F.sum("n").alias("n"), F.min("upstream_time_s").alias("min"), (F.sum(F.col("upstream_time_s") * F.col("n")) / F.sum("n")).alias("mean"),
        at(0.5, "median"), at(0.95, "p95"), at(0.99, "p99"), F.max("upstream_time_s").alias("max"),
    )
    return found.withColumn("window_end", F.timestamp_seconds(F.unix_seconds("window_start") + length))


SAMPLE_SCHEMA = "event_id bigint, ts timestamp, upstream_time_s double"


def last_samples(log: DataFrame, state: BatchedState, checkpoint: str, n: int = 100) -> DataStreamWriter:
    """Keep the newest ``n`` latency samples.

    Each micro-batch is cut to its own newest n in parallel before it meets the state, so no task and no
    state entry ever holds more than n rows however fast the log grows.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = [F.col("ts").desc(), F.col("event_id").desc()]
        rows = telemetry.getmap_only(batch).select("event_id", "ts", X.safe_double("upstream_time_s").alias("upstream_time_s"))
        merged = ranks.last_n(ranks.last_n(rows, order, n).union(state.before(spark, batch_id)).distinct(), order, n)
        state.save(merged, batch_id)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latency_percentiles(log: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exact latency figures of each micro-batch's map requests, one folder per batch."""

    def report(batch: DataFrame, batch_id: int) -> None:
        samples = telemetry.with_numbers(telemetry.getmap_only(batch))
        telemetry.latency_block(samples).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return log.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint)


def rollup_to(lines: DataFrame, state: BatchedState, checkpoint: str) -> DataStreamWriter:
    """Scan progress kept as a table: the changed jobs of each micro-batch replace their older rows."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # used twice: the stateful aggregate must not run again
        try:
            old = state.before(batch.sparkSession, batch_id)
            kept = old.join(batch.select("job_id"), "job_id", "left_anti")
            state.save(kept.unionByName(batch), batch_id)
        finally:
            batch.unpersist()

    return scan_progress(lines).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
