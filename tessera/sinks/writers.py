"""Tile index, footprint table, staged index, catalog document and feature export."""

from __future__ import annotations

import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import catalog as K
from ..operators import staging
from ..sources import files, readers

ROW_GROUP_ROWS = 2048
CATALOG_VERSION = 1
# Header of a catalog document.
CATALOG_HEADER = {
    "type": "Catalog",
    "stac_version": "1.0.0",
    "id": "raster-catalog",
    "title": "Raster footprint catalog",
    "description": "Catalog of raster collections",
    "version": CATALOG_VERSION,
}


def write_tile_index(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Tile index partitioned by collection and EPSG code, rows in key order.

    Range partitioning on (collection, code, key) splits a huge collection over many tasks and gives each
    file its own key range. Everything is written to a draft folder first; when that is complete, each
    collection in it takes the place of the old one as a whole, so a code that a rescan no longer finds
    does not linger. The old one is moved aside and comes back if the new one cannot take its place; what a crash leaves
    aside is put back by the next call. Rows without a code belong to no group.
    """
    spark = df.sparkSession
    keys = ["collection_id", "native_epsg", "key"]
    grouped = df.where(F.col("native_epsg").isNotNull())
    ranged = grouped.repartitionByRange(partitions, *keys) if partitions else grouped.repartitionByRange(*keys)
    draft, aside = f"{path}/_draft-{uuid.uuid4().hex}", f"{path}/_replaced"
    _put_back(spark, path, aside)
    try:
        ranged.sortWithinPartitions(*keys).write.partitionBy("collection_id", "native_epsg").parquet(draft)
        for name in files.children(spark, draft):
            if name.startswith("collection_id="):
                if files.exists(spark, f"{path}/{name}"):
                    files.make_folder(spark, aside)
                    files.move(spark, f"{path}/{name}", f"{aside}/{name}")
                files.move(spark, f"{draft}/{name}", f"{path}/{name}")
                files.remove(spark, f"{aside}/{name}")
    finally:
        _put_back(spark, path, aside)
        files.remove(spark, draft)


def _put_back(spark: SparkSession, path: str, aside: str) -> None:
    """Collections that were moved aside and whose place is empty return to it."""
    for name in files.children(spark, aside):
        if files.exists(spark, f"{path}/{name}"):
            files.remove(spark, f"{aside}/{name}")
        else:
            files.move(spark, f"{aside}/{name}", f"{path}/{name}")


def replace_collection(df: DataFrame, path: str, collection_id: str, partitions: int | None = None) -> int:
    """Replace one collection in the footprint table by ``df`` (all EPSG groups in one job); returns its row count.

    The table is partitioned by collection only, so the swap of one partition replaces every group at once.
    An empty ``df`` removes the collection.
    """
    spark = df.sparkSession
    rows = df.where(F.col("collection_id") == collection_id)
    if rows.isEmpty():
        files.remove(spark, f"{path}/collection_id={collection_id}")
        return 0
    keys = ["collection_id", "native_epsg", "key"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    (
        ranged.sortWithinPartitions(*keys)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("collection_id").parquet(path)
    )
    return spark.read.schema(df.schema).parquet(path).where(F.col("collection_id") == collection_id).count()


def delete_index_rows(spark: SparkSession, path: str, collection_id: str) -> int:
    """Drop a collection's partition; returns the number of rows it had."""
    folder = f"{path}/collection_id={collection_id}"
    if not files.exists(spark, folder):
        return 0
    n = spark.read.parquet(folder).count()
    files.remove(spark, folder)
    return n


def write_staged_index(
    df: DataFrame, path: str, box: str = "bbox", partition_by: tuple[str, ...] = (), partitions: int | None = None,
    world: float = 20037508.342789244, tie: tuple[str, ...] = (),
) -> None:
    """ZSTD Parquet in spatial order with small row groups and the box as a struct column.

    Each row group then covers a small area, and the statistics of the four box edges let a window query
    skip the rest.
    """
    writer = (
        staging.cluster_spatially(df, box, partitions, world, partition_by, tie)
        .write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    write_file_boxes(df.sparkSession, path, box)


def write_file_boxes(spark: SparkSession, path: str, box: str = "bbox") -> None:
    """The box around the rows of each file, kept inside the index under a name that scans of it leave out.

    File names are relative to the index, so it can be moved or published as a whole.
    """
    inside = F.lit(len(files.bare_text(files.qualified(spark, path)).rstrip("/")) + 2)
    # of the index as it is: an earlier table of boxes is hidden from this scan
    rows = spark.read.parquet(path).select(files.decoded(F.col("_metadata.file_path")).alias("__name"), box)
    edges = [f(f"{box}.{e}").alias(e) for e, f in zip(G.BBOX_FIELDS, (F.min, F.min, F.max, F.max))]
    boxes = rows.groupBy(F.substring("__name", inside, F.length("__name")).alias("file")).agg(*edges, F.count(F.lit(1)).alias("n"))
    boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/{files.FILE_BOXES}")


def feature_lines(df: DataFrame, ring: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, as ``feature`` text."""
    coordinates = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return df.withColumn(
        "feature",
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(*properties).alias("properties"),
                F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            ),
            {"ignoreNullFields": "false"},
        ),
    )


def crs_name(epsg: int) -> str:
    return f"urn:ogc:def:crs:EPSG::{epsg}"


def export_features(df: DataFrame, path: str, ring: str, properties: list[str], epsg: str = "epsg") -> None:
    """Newline-delimited GeoJSON features, one folder per EPSG code; each feature names its CRS."""
    lines = feature_lines(df.withColumn("crs", F.concat(F.lit("urn:ogc:def:crs:EPSG::"), F.col(epsg))), ring, [*properties, "crs"])
    lines.select(F.col(epsg).alias("epsg"), F.col("feature").alias("value")).write.mode("overwrite").partitionBy("epsg").text(path)


def catalog_lines(catalog: DataFrame) -> DataFrame:
    """``position, value``: one collection document per row."""
    return catalog.select("position", F.to_json("fields", {"ignoreNullFields": "false"}).alias("value"))


def write_catalog(catalog: DataFrame, path: str, header: dict | None = None) -> None:
    """Catalog document.

    A document is one file by nature; the collections stream through its writer one line each instead of
    being gathered into one value. The file is swapped in when complete.
    """
    spark = catalog.sparkSession
    head = json.dumps(header or CATALOG_HEADER)[:-1] + ', "collections": ['
    last = catalog.agg(F.max("position")).first()[0]
    body = catalog_lines(catalog).select(
        F.col("position"), F.concat("value", F.when(F.col("position") < F.lit(last), F.lit(",")).otherwise(F.lit(""))).alias("value")
    )
    frame = spark.createDataFrame([(-1, head), (2**62, "]}")], "position bigint, value string")
    draft = f"{path}.draft"
    ordered = body.union(frame).repartition(1).sortWithinPartitions("position")
    ordered.select("value").write.mode("overwrite").text(draft)
    part = next(n for n in files.children(spark, draft) if n.startswith("part-"))
    files.move_over(spark, f"{draft}/{part}", path)
    files.remove(spark, draft)


def upsert_catalog_document(entries: DataFrame, path: str) -> None:
    """Merge entries into the document at ``path``: its other keys and its collections stay.

    A document that exists but cannot be read is an error and is left as it is; a version that is not the expected one
    only gives a warning.
    """
    spark = entries.sparkSession
    header = readers.catalog_header(spark, path)
    if header is not None and header.get("version") != CATALOG_VERSION:
        print(f"WARN: {path} has version {header.get('version')}, expected {CATALOG_VERSION}", file=sys.stderr)
    merged = K.upsert_catalog(readers.read_catalog(spark, path), entries)
    write_catalog(merged, path, header)


def delete_collection_everywhere(spark: SparkSession, collection_id: str, catalog_path: str, table: str | None = None, tile_index: str | None = None) -> int:
    """Remove a collection from the catalog document, the footprint table and the tile index; returns its rows in the table.

    An unknown id is an error and changes nothing. The catalog goes first: what it does not name is not served, and a call
    that failed afterwards can be repeated with ``delete_index_rows``.
    """
    remaining = K.delete_collection(readers.read_catalog(spark, catalog_path), collection_id)
    write_catalog(remaining, catalog_path, readers.catalog_header(spark, catalog_path))
    n = delete_index_rows(spark, table, collection_id) if table else 0
    if tile_index:
        files.remove(spark, f"{tile_index}/collection_id={collection_id}")
    return n
