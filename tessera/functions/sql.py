"""SQL functions for use in ``spark.sql``; Catalyst inlines them into the query's own expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_EXTENT = "20037508.342789244D"

DEFINITIONS = {
    "tile_x": ("lon DOUBLE, z INT", "INT", "CAST((lon + 180) / 360 * power(2D, z) AS INT)"),
    "tile_y": ("lat DOUBLE, z INT", "INT", "CAST((1 - asinh(tan(radians(lat))) / pi()) / 2 * power(2D, z) AS INT)"),
    "tile_size": ("z INT", "DOUBLE", f"2 * {_EXTENT} / power(2D, z)"),
    "tile_xmin": ("x INT, z INT", "DOUBLE", f"-{_EXTENT} + x * (2 * {_EXTENT} / power(2D, z))"),
    "tile_ymin": ("y INT, z INT", "DOUBLE", f"{_EXTENT} - (y + 1) * (2 * {_EXTENT} / power(2D, z))"),
    "tile_xmax": ("x INT, z INT", "DOUBLE", f"-{_EXTENT} + (x + 1) * (2 * {_EXTENT} / power(2D, z))"),
    "tile_ymax": ("y INT, z INT", "DOUBLE", f"{_EXTENT} - y * (2 * {_EXTENT} / power(2D, z))"),
    "raster_zoom": (
        "web_width DOUBLE, width INT", "DOUBLE",
        f"CASE WHEN web_width > 0 AND width > 0 THEN log2(2 * {_EXTENT} / (256 * (web_width / width))) END",
    ),
    "boxes_intersect": (
        "ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE", "BOOLEAN",
        "ax0 <= bx1 AND ax1 >= bx0 AND ay0 <= by1 AND ay1 >= by0",
    ),
    "box_contains": (
        "ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE", "BOOLEAN",
        "ax0 <= bx0 AND ay0 <= by0 AND ax1 >= bx1 AND ay1 >= by1",
    ),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
