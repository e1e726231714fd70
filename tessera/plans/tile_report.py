"""Tile candidates of an area: which tiles are interior, seam, partial, too dense or empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geometry as G
from ..functions import tiles as T
from ..operators import footprints as P
from ..operators import spatial, tilegen


def covered_range(footprints: DataFrame, zoom: int, box: str = "bbox", by: tuple[str, ...] = ()) -> DataFrame:
    """``bounds`` (lat/lon pairs) and tile ``range`` of the footprints' extent, one row per ``by``."""
    area = P.extent(footprints, by, ring=None, box=box)
    bounded = area.select(*by, G.bounds_from_bbox(C.web_bbox_to_lonlat("extent")).alias("bounds"))
    return bounded.withColumn("range", tilegen.tile_range("bounds", F.lit(zoom)))


def area_tiles(footprints: DataFrame, zoom: int, box: str = "bbox", by: tuple[str, ...] = ()) -> DataFrame:
    return tilegen.tile_grid(covered_range(footprints, zoom, box, by), zoom, by)


def area_classes(footprints: DataFrame, zoom: int, box: str = "bbox", by: tuple[str, ...] = (), ring: str | None = None) -> DataFrame:
    return spatial.classify_range(covered_range(footprints, zoom, box, by), footprints, zoom, box, by, ring)


def area_report(footprints: DataFrame, zoom: int, box: str = "bbox", by: tuple[str, ...] = ()) -> DataFrame:
    return spatial.class_stats(area_classes(footprints, zoom, box, by), *by)


def prepare_tiles(footprints: DataFrame, zoom: int, requests: int = 50, seed: int = 0, layer: str = "imagery") -> DataFrame:
    """Sampled usable tiles with the request address of each."""
    draws = tilegen.classify_in_rounds(covered_range(footprints, zoom), footprints, zoom, requests, seed)
    picked = tilegen.sample_tiles(draws, requests)
    return picked.withColumn("url", T.tile_request_url(F.lit(layer), T.tile_bbox("x", "y", "z")))


def prepare_collection(
    collections: DataFrame, collection_id: str, footprints: DataFrame, requests: int = 50, seed: int = 0,
    requested: int | None = None, viewer_zoom: int | None = None, layer: str = "imagery",
) -> DataFrame:
    """``prepare_tiles`` at the zoom that the request, the collection's catalog row or the viewer names, in that order."""
    row = collection_zoom(collections.where(F.col("id") == collection_id), requested, viewer_zoom).select("zoom").first()
    if row is None:
        raise ValueError(f"no collection {collection_id} in the catalog")
    return prepare_tiles(footprints, row["zoom"], requests, seed, layer)


def collection_zoom(collections: DataFrame, requested: int | None = None, viewer_zoom: int | None = None) -> DataFrame:
    """``zoom`` each collection is measured at."""
    return collections.withColumn(
        "zoom", T.resolve_zoom(F.lit(requested), "native_zoom", F.lit(viewer_zoom))
    )
