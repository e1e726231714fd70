"""Index staging and refresh: selections -> lake partitions -> staged generation and its catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import catalog as K
from ..operators import staging
from ..sinks import generations, writers
from ..sources import files, readers

#: The catalog of a generation, beside its index.
CATALOG = "_catalog.json"


def staged_rows(lake: DataFrame, proxy_base: str, access_mode: str = "requester-pays", region: str = "us-west-2") -> DataFrame:
    return staging.staged_columns(staging.with_boxes(lake), proxy_base, access_mode, region)


def staged_entries(
    summary: DataFrame, selections: DataFrame, root: str, access_mode: str, region: str, group: str = "naip",
    indexed_at: Column | None = None,
) -> DataFrame:
    """Catalog rows of staged selections (``index_summary`` joined with the selections' labels)."""
    stamp = F.date_format(indexed_at if indexed_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    facts = summary.join(
        selections.select(F.col("state").alias("region"), F.col("year").cast("int").alias("year"), "label", "resolved_uri"),
        ["region", "year"],
    )
    cid = F.concat_ws("-", F.lit("naip"), "region", F.col("year").cast("string"))
    label = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("NAIP "), F.upper("region"), F.lit(" "), F.col("year").cast("string")))
    path = F.concat(F.lit(f"{root}/region="), F.col("region"), F.lit("/year="), F.col("year").cast("string"))
    box = G.bbox_array("bbox_4326")
    web = F.transform(G.bbox_array("extent_3857"), lambda v: v.cast("bigint"))
    rows = facts.select(
        F.lit("Collection").alias("type"),
        F.lit("1.0.0").alias("stac_version"),
        cid.alias("id"),
        label.alias("title"),
        F.concat(F.lit("NAIP imagery for "), F.upper("region"), F.lit(" "), F.col("year").cast("string"), F.lit(" from GeoParquet")).alias("description"),
        F.lit("various").alias("license"),
        cid.alias("layer_name"),
        F.array(cid).alias("layer_names"),
        F.lit("naip-imagery").alias("map_name"),
        label.alias("label"),
        F.lit("USDA NAIP").alias("attribution"),
        F.lit(True).alias("enabled"),
        F.lit(group).alias("group"),
        F.lit(12).alias("min_zoom"),
        F.lit(20).alias("max_zoom"),
        F.lit(18).alias("native_zoom"),
        F.col("year").alias("draw_order"),
        F.lit("parquet").alias("backend"),
        F.lit(True).alias("parquet"),
        F.struct(
            F.col("resolved_uri").alias("uri"), F.lit(region).alias("region"), F.lit(access_mode).alias("access_mode"),
            F.lit(access_mode == "requester-pays").alias("requester_pays"), F.col("region").alias("state"), "year",
        ).alias("source"),
        F.lit(4326).alias("native_epsg"),
        "native_epsgs",
        "cog_count",
        box.alias("bbox_4326"),
        web.alias("extent_3857"),
        box.alias("extent_native"),
        path.alias("tileindex"),
        cid.alias("tileindex_layer_name"),
        F.array(
            F.struct(
                F.lit(4326).alias("epsg"), path.alias("tileindex"), cid.alias("tileindex_layer_name"), cid.alias("layer_name"),
                box.alias("extent_native"), F.col("cog_count"), F.lit("location").alias("tileitem"),
                F.lit("tile_srs").alias("tilesrs"), F.lit(True).alias("mixed_srs"),
            )
        ).alias("tileindexes"),
        stamp.alias("indexed_at"),
        F.array(F.lit("BANDS=1,2,3"), F.lit("RESAMPLE=AVERAGE")).alias("raster_processing"),
        # Sortable position: by year, then state.
        (F.col("year").cast("bigint") * 65536 + F.ascii("region") * 256 + F.ascii(F.substring("region", 2, 1))).alias("position"),
    )
    return K.untyped(rows)


def refresh(
    spark: SparkSession, selection_json: str, lake_root: str, target_root: str, uri_template: str,
    proxy_base: str = "http://localhost:8001", access_mode: str = "requester-pays", region: str = "us-west-2",
    catalog_path: str | None = None,
) -> str:
    """Stage the selected partitions as one job and publish them with their catalog as one generation.

    ``catalog_path`` names a copy of the catalog outside; it is replaced after the pointer has moved, and if that fails,
    the pointer goes back.

    The lake's rows carry ``bbox`` (lon/lat struct) or a binary ``geometry``, ``source_bucket``, ``source_key`` and ``proj_epsg``.
    """
    selections = staging.resolve_uris(readers.read_selections(spark, selection_json), uri_template)
    rows = staged_rows(readers.read_selected(spark, lake_root, selections), proxy_base, access_mode, region)

    def write(df: DataFrame, path: str) -> None:
        writers.write_staged_index(df, path, partition_by=("region", "year"), world=180.0, tie=("source_key",))

    def check(written: DataFrame) -> None:
        wanted = selections.select(F.col("state").alias("region"), F.col("year").cast("int").alias("year"))
        missing = wanted.join(written.select("region", "year").distinct(), ["region", "year"], "left_anti")
        gap = missing.limit(1).collect()
        if gap:
            raise RuntimeError(f"no footprints for selection {gap[0]['region']}:{gap[0]['year']}")

    def document(written: DataFrame, path: str) -> None:
        entries = staged_entries(staging.index_summary(written), selections, path, access_mode, region)
        writers.write_catalog(entries, f"{path}/{CATALOG}")

    def copy(path: str) -> None:
        if catalog_path:
            files.copy_over(spark, f"{path}/{CATALOG}", catalog_path)

    return generations.publish_generation(rows, target_root, write, check, documents=document, after=copy)


def read_published(spark: SparkSession, target_root: str) -> tuple[DataFrame, DataFrame]:
    """(index, catalog) of the current generation: always a pair."""
    path = f"{target_root}/{generations.PREFIX}{generations.current_generation(spark, target_root)}"
    text = files.read_text(spark, f"{path}/{CATALOG}")  # the scan of the index leaves names with an underscore out
    return spark.read.parquet(path), readers.parse_catalog(spark.createDataFrame([(text,)], "doc string"))
