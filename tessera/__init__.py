"""Footprint indexes, tile coverage and serving telemetry as Spark DataFrame operators.

Sub-packages

* ``functions``  column expressions (geometry, tiles, CRS, text) and the SQL functions built on them
* ``operators``  DataFrame -> DataFrame operators (spatial join, coverage, extents, ranks, catalog, telemetry)
* ``sources``    readers (listing, headers, lake, selections, catalog, features, index, logs)
* ``sinks``      writers (tile index, staged index, generations, catalog document, feature export)
* ``plans``      whole jobs composed of the above
* ``streaming``  Structured Streaming versions of the log and index operators
* ``checks``     the registered queries and the SQL they are compared with
"""

__all__ = ["functions", "operators", "sources", "sinks", "plans", "streaming", "checks"]
