"""Immutable index generations with a pointer to the current one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import files

POINTER = "_current.json"
STATUS = "_status.json"
LEASE = "_lease"
PREFIX = "generation="


def current_generation(spark: SparkSession, root: str) -> str | None:
    text = files.read_text(spark, f"{root}/{POINTER}")
    return json.loads(text)["generation"] if text else None


def read_generation(spark: SparkSession, root: str) -> DataFrame:
    current = current_generation(spark, root)
    if current is None:
        raise FileNotFoundError(f"no generation published under {root}")
    return spark.read.parquet(f"{root}/{PREFIX}{current}")


def status(spark: SparkSession, root: str) -> dict:
    text = files.read_text(spark, f"{root}/{STATUS}")
    return json.loads(text) if text else {}


def stale_generations(known: DataFrame, current: DataFrame) -> DataFrame:
    """Generations that are no longer pointed to."""
    return known.join(current, "generation", "left_anti")


def publish_generation(
    df: DataFrame, root: str, write: Callable[[DataFrame, str], None] | None = None,
    validate: Callable[[DataFrame], None] | None = None, expected_rows: int | None = None,
    documents: Callable[[DataFrame, str], None] | None = None, after: Callable[[str], None] | None = None, lease_seconds: float = 6 * 3600,
) -> str:
    """Write ``df`` as a new generation with its ``documents``, check it, switch the pointer, then drop the old ones.

    Index and documents lie in the generation's folder, so one rename of the pointer commits both: readers see the old
    pair or the new one, never a mix. ``after`` runs once the pointer has moved (to copy a document elsewhere); if it
    fails, the pointer goes back. On any failure the new folder is removed, the old generation stays current and the
    status says ``failed``. Old generations are deleted last. A lease keeps two publications from running at once.
    """
    spark = df.sparkSession
    generation = uuid.uuid4().hex
    target = f"{root}/{PREFIX}{generation}"
    with files.Lease(spark, f"{root}/{LEASE}", lease_seconds):
        before = files.read_text(spark, f"{root}/{POINTER}")
        try:
            if write is None:
                df.write.parquet(target)
            else:
                write(df, target)
            written = spark.read.parquet(target)
            n = written.count()  # answered from the file footers
            if expected_rows is not None and n != expected_rows:
                raise RuntimeError(f"generation {generation} has {n} rows, expected {expected_rows}")
            if validate is not None:
                validate(written)
            if documents is not None:
                documents(written, target)
            files.write_text(spark, f"{root}/{POINTER}", json.dumps({"generation": generation, "rows": n}))
            if after is not None:
                after(target)
        except Exception as error:
            if before is None:
                files.remove(spark, f"{root}/{POINTER}")
            elif files.read_text(spark, f"{root}/{POINTER}") != before:
                files.write_text(spark, f"{root}/{POINTER}", before)
            files.remove(spark, target)
            files.write_text(
                spark, f"{root}/{STATUS}", json.dumps({"status": "failed", "generation": generation, "error": str(error)})
            )
            raise
        for name in stale_names(spark, root, generation):
            files.remove(spark, f"{root}/{PREFIX}{name}")
        files.write_text(spark, f"{root}/{STATUS}", json.dumps({"status": "ready", "generation": generation, "rows": n}))
    return generation


def stale_names(spark: SparkSession, root: str, current: str) -> list[str]:
    """Generations under ``root`` that are no longer pointed to."""
    found = [(n[len(PREFIX):],) for n in files.children(spark, root) if n.startswith(PREFIX)]
    known, now = spark.createDataFrame(found, "generation string"), spark.createDataFrame([(current,)], "generation string")
    return [r["generation"] for r in stale_generations(known, now).toLocalIterator()]
