"""Incremental index load: loads of collections arrive in any order, and the newest one of each collection counts.

Rows and the knowledge of which load is current are stored apart::

    path/collection_id=…/load=…/batch=…/   footprint rows as they came
    path/_ledger/batch=…/                  the loads that a micro-batch held rows of

A micro-batch writes its own folders only and reads none of the stored rows. Run again, it overwrites them by the same
rows, so repeated, late and reordered batches all end in the same table: the rows of the highest load in the ledger, of a
repeated location the one of the highest ``seq``. Rows go first and the ledger last; a load is invisible until then.
``readers.read_index`` looks at the ledger where there is one.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..sources import files, readers
from ..sources.readers import LEDGER


def load_number(df: DataFrame, name: str = "load") -> Column:
    """The order of a load: whole numbers as they are, instants in microseconds, text read as either."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("bigint")
    if not isinstance(kind, T.StringType):
        raise TypeError(f"a load is a whole number, an instant or text of one, not {kind.simpleString()}")
    bad = F.raise_error(F.concat(F.lit("not a load number or time: "), F.coalesce(F.col(name), F.lit("null")))).cast("bigint")
    return F.coalesce(F.col(name).try_cast("bigint"), F.unix_micros(F.col(name).try_cast("timestamp")), bad)


def replace_collections(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Stream footprint rows with ``collection_id``, ``native_epsg``, ``key``, ``location``, ``seq`` and ``load`` into the table.

    ``load`` orders the scans of a collection by number or time. Rows of a load may be spread over any number of
    micro-batches, and a later load drops the rasters that it does not list. Rows without the column belong to one load,
    that of the checkpoint, which counts from the time of its first start.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = load_number(batch) if "load" in batch.columns else F.lit(started(spark, path, name))
        # two streams into one table number their batches alike
        numbered = batch.withColumn("load", number).withColumn("batch", F.lit(f"{name}-{batch_id}"))
        numbered.persist()
        try:
            keys = ["collection_id", "load", "native_epsg", "key"]
            (
                numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("collection_id", "load", "batch").parquet(path)
            )
            seen = numbered.select("collection_id", "load").distinct()
            seen.write.mode("overwrite").parquet(f"{path}/{LEDGER}/batch={name}-{batch_id}")
        finally:
            numbered.unpersist()
        if batch_id % 50 == 49:
            remove_superseded(spark, path)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def started(spark: SparkSession, path: str, name: str) -> int:
    """When a checkpoint first wrote to the table, in microseconds; kept with the table, so a restart finds it again."""
    mark = f"{path}/_started/{name}"
    files.create_new(spark, mark, str(time.time_ns() // 1000))
    return int(files.read_text(spark, mark))


def remove_superseded(spark: SparkSession, path: str) -> int:
    """Delete the folders of loads that no longer count; returns how many. Only names of folders are looked at."""
    newest = {r["collection_id"]: r["load"] for r in readers.current_loads(spark, path).toLocalIterator()}
    gone = 0
    for folder in files.children(spark, path):
        if not folder.startswith("collection_id="):
            continue
        current = newest.get(files.unescaped(folder.split("=", 1)[1]))
        for load in files.children(spark, f"{path}/{folder}"):
            if current is not None and load.startswith("load=") and int(load[5:]) < current:
                files.remove(spark, f"{path}/{folder}/{load}")
                gone += 1
    return gone
