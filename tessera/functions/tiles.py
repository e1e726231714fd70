"""Web-Mercator tile arithmetic as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import BBOX_FIELDS, col, plain_number

# Fixed values shared with every XYZ tile client.
WEB_EXTENT = 20037508.342789244
EARTH_RADIUS = 6378137.0
TILE_PIXELS = 256
DEFAULT_NATIVE_ZOOM = 18


def tiles_per_axis(zoom) -> Column:
    return F.pow(F.lit(2.0), col(zoom).cast("double"))


def tile_size(zoom) -> Column:
    """Edge of a tile in metres."""
    return F.lit(2.0 * WEB_EXTENT) / tiles_per_axis(zoom)


def lonlat_to_tile_x(lon, zoom) -> Column:
    return ((col(lon) + 180.0) / 360.0 * tiles_per_axis(zoom)).cast("int")


def lonlat_to_tile_y(lat, zoom) -> Column:
    turn = F.asinh(F.tan(F.radians(col(lat)))) / F.lit(math.pi)
    return ((F.lit(1.0) - turn) / 2.0 * tiles_per_axis(zoom)).cast("int")


def lonlat_to_tile(lon, lat, zoom) -> Column:
    """Tile that holds a point; fractions are cut toward zero."""
    return F.struct(
        col(zoom).cast("int").alias("z"),
        lonlat_to_tile_x(lon, zoom).alias("x"),
        lonlat_to_tile_y(lat, zoom).alias("y"),
    )


def tile_bbox(x: str, y: str, zoom: str | int) -> Column:
    """Box of a tile in EPSG:3857, from column names (or SQL text)."""
    size = f"({2.0 * WEB_EXTENT!r}D / power(2D, {zoom}))"
    e = f"{WEB_EXTENT!r}D"
    edges = (f"-{e} + {x} * {size}", f"{e} - ({y} + 1) * {size}", f"-{e} + ({x} + 1) * {size}", f"{e} - {y} * {size}")
    return F.expr(f"named_struct({', '.join(f"'{n}', {v}" for n, v in zip(BBOX_FIELDS, edges))})")


def bbox_text(box) -> Column:
    """``xmin,ymin,xmax,ymax`` as request text."""
    b = col(box)
    return F.concat_ws(",", *(plain_number(b[f]) for f in ("xmin", "ymin", "xmax", "ymax")))


def tile_request_url(layer, box, base: str = "http://127.0.0.1/mapserv") -> Column:
    return F.concat(
        F.lit(base + "?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS="),
        col(layer),
        F.lit("&CRS=EPSG:3857&BBOX="),
        bbox_text(box),
        F.lit("&WIDTH=256&HEIGHT=256&FORMAT=image/png"),
    )


def native_zoom(web_box, width) -> Column:
    """Zoom at which one screen pixel is one raster pixel; null for a degenerate raster."""
    b, w = col(web_box), col(width)
    span = b["xmax"] - b["xmin"]
    metres = span / w
    return F.when((span > 0) & (w > 0), F.log2(F.lit(2.0 * WEB_EXTENT) / (F.lit(float(TILE_PIXELS)) * metres)))


def zoom_range(native, requested_min=None, requested_max=None) -> Column:
    n = col(native)
    low = n - 4 if requested_min is None else F.coalesce(col(requested_min), n - 4)
    high = n + 1 if requested_max is None else F.coalesce(col(requested_max), n + 1)
    return F.struct(low.cast("int").alias("min_zoom"), high.cast("int").alias("max_zoom"))


def zoom_relation(zoom, native) -> Column:
    """``native``, ``+n · upsampled`` or ``-n · downsampled``."""
    d = (col(zoom) - col(native)).cast("int")
    text = d.cast("string")
    return (
        F.when(d == 0, F.lit("native"))
        .when(d > 0, F.concat(F.lit("+"), text, F.lit(" · upsampled")))
        .when(d < 0, F.concat(text, F.lit(" · downsampled")))
    )


def resolve_zoom(requested, collection_zoom, viewer_zoom) -> Column:
    """The requested zoom if given; else the first non-zero of collection and viewer zoom; else 18."""
    return F.coalesce(
        col(requested).cast("int"),
        F.nullif(col(collection_zoom).cast("int"), F.lit(0)),
        F.nullif(col(viewer_zoom).cast("int"), F.lit(0)),
        F.lit(DEFAULT_NATIVE_ZOOM),
    )
