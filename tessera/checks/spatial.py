"""Tile mathematics, the spatial join, coverage, classes, samples and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import derive
from ..functions import crs as C
from ..functions import geometry as G
from ..functions import sql as S
from ..functions import tiles as T
from ..operators import footprints as P
from ..operators import spatial, tilegen
from ..plans import tile_report
from ..session import materialize
from .common import E, R, boxed, ctes, footprints, unboxed, utm_boxes

TILE_BOX = """
-{E} + x * (2 * {E} / pow(2, z)) AS txmin, {E} - (y + 1) * (2 * {E} / pow(2, z)) AS tymin,
-{E} + (x + 1) * (2 * {E} / pow(2, z)) AS txmax, {E} - y * (2 * {E} / pow(2, z)) AS tymax""".replace("{E}", E)


def lonlat(box: str = "") -> str:
    return f"""degrees({box}xmin / {R}) AS lon0, degrees({box}xmax / {R}) AS lon1,
degrees(atan(sinh({box}ymin / {R}))) AS lat0, degrees(atan(sinh({box}ymax / {R}))) AS lat1"""


def tile_x(lon: str, z) -> str:
    return f"CAST(trunc(({lon} + 180) / 360::DOUBLE * pow(2::DOUBLE, {z})) AS INT)"


def tile_y(lat: str, z) -> str:
    return f"CAST(trunc((1 - asinh(tan(radians({lat}))) / pi()) / 2 * pow(2::DOUBLE, {z})) AS INT)"


def range_sql(z, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""ext AS (SELECT {lead}min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM fx_footprints {group}),
geo AS (SELECT {lead}{lonlat()} FROM ext),
rng AS (SELECT {lead}{z} AS z, {tile_x('lon0', z)} AS x_min, {tile_x('lon1', z)} AS x_max, {tile_y('lat1', z)} AS y_min, {tile_y('lat0', z)} AS y_max FROM geo)"""


def grid_sql(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""tiles AS (SELECT *, {TILE_BOX} FROM (
  SELECT {lead}z, x, CAST(unnest(generate_series(y_min, y_max)) AS INT) AS y FROM (
    SELECT {lead}z, y_min, y_max, CAST(unnest(generate_series(x_min, x_max)) AS INT) AS x FROM rng)))"""


def pairs_sql(by: str = "") -> str:
    same = f"AND t.{by} = f.{by}" if by else ""
    return f"""pairs AS (SELECT t.*, f.id, f.key, f.xmin, f.ymin, f.xmax, f.ymax FROM tiles t JOIN fx_footprints f
  ON f.xmin <= t.txmax AND f.xmax >= t.txmin AND f.ymin <= t.tymax AND f.ymax >= t.tymin {same})"""


def class_sql(by: str = "") -> str:
    """Classes with coverage by coordinate compression: cut each tile at all box edges and add up covered cells."""
    k = f"{by}, z, x, y" if by else "z, x, y"
    on = " AND ".join(f"a.{c} = b.{c}" for c in k.split(", "))
    return f"""counts AS (SELECT {k}, count(*) AS n, bool_or(xmin <= txmin AND ymin <= tymin AND xmax >= txmax AND ymax >= tymax) AS inside FROM pairs GROUP BY {k}),
hits AS (SELECT {k}, coalesce(n, 0) AS cog_count, coalesce(inside, false) AS inside_one FROM tiles LEFT JOIN counts USING ({k})),
open_pairs AS (SELECT p.* FROM pairs p JOIN hits USING ({k}) WHERE cog_count <= 4 AND NOT inside_one),
xs AS (SELECT {k}, v, lead(v) OVER (PARTITION BY {k} ORDER BY v) AS w FROM (
  SELECT {k}, greatest(xmin, txmin) AS v FROM open_pairs UNION SELECT {k}, least(xmax, txmax) FROM open_pairs)),
ys AS (SELECT {k}, v, lead(v) OVER (PARTITION BY {k} ORDER BY v) AS w FROM (
  SELECT {k}, greatest(ymin, tymin) AS v FROM open_pairs UNION SELECT {k}, least(ymax, tymax) FROM open_pairs)),
cells AS (SELECT {', '.join('a.' + c for c in k.split(', '))}, a.v AS x0, a.w AS x1, b.v AS y0, b.w AS y1 FROM xs a JOIN ys b ON {on} WHERE a.w IS NOT NULL AND b.w IS NOT NULL),
covered AS (SELECT DISTINCT {', '.join('a.' + c for c in k.split(', '))}, x0, x1, y0, y1 FROM cells a JOIN open_pairs b ON {on}
  AND b.xmin <= x0 AND b.xmax >= x1 AND b.ymin <= y0 AND b.ymax >= y1),
shares AS (SELECT {k}, sum((x1 - x0) * (y1 - y0)) / ((2 * {E} / pow(2, z)) * (2 * {E} / pow(2, z))) AS coverage FROM covered GROUP BY {k}),
classes AS (SELECT {k}, cog_count, inside_one,
  CASE WHEN cog_count = 0 OR cog_count > 4 OR inside_one THEN NULL ELSE coalesce(coverage, 0) END AS coverage,
  CASE WHEN cog_count = 0 THEN 'empty' WHEN cog_count > 4 THEN 'too_many' WHEN inside_one THEN 'interior'
       WHEN coalesce(coverage, 0) >= 0.999::DOUBLE THEN 'seam' ELSE 'partial' END AS class
  FROM hits LEFT JOIN shares USING ({k}))"""


def with_area(z, *more: str, by: str = "") -> str:
    return "WITH " + ",\n".join([ctes("fx_footprints"), range_sql(z, by), grid_sql(by), *more])


STATS_SQL = """
count(*) FILTER (WHERE class = 'empty') AS empty, count(*) FILTER (WHERE class = 'interior') AS interior,
count(*) FILTER (WHERE class = 'seam') AS seam, count(*) FILTER (WHERE class = 'partial') AS partial,
count(*) FILTER (WHERE class = 'too_many') AS too_many, count(*) AS tiles,
min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max"""


# --- tile mathematics -------------------------------------------------------------------------


def _centres(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("bbox")
    mid = G.point((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2)
    return footprints(spark, sf).select("id", C.web_to_lonlat(mid).alias("p"))


def tile_math(spark, sf):
    tiled = _centres(spark, sf).select("id", T.lonlat_to_tile("p.x", "p.y", F.lit(17)).alias("t"))
    boxed = tiled.select("id", "t.z", "t.x", "t.y", T.tile_bbox("t.x", "t.y", "t.z").alias("bbox"))
    return unboxed(boxed)


TILE_MATH = f"""WITH {ctes('fx_footprints')},
p AS (SELECT id, degrees((xmin + xmax) / 2 / {R}) AS lon, degrees(atan(sinh((ymin + ymax) / 2 / {R}))) AS lat FROM fx_footprints),
t AS (SELECT id, 17 AS z, {tile_x('lon', 17)} AS x, {tile_y('lat', 17)} AS y FROM p)
SELECT id, z, x, y, txmin AS xmin, tymin AS ymin, txmax AS xmax, tymax AS ymax FROM (SELECT *, {TILE_BOX} FROM t)"""


def tile_functions_sql(spark, sf):
    """The same arithmetic through the registered SQL functions."""
    S.register(spark)
    return spark.sql(
        """
        SELECT id, tile_x(p.x, 12) AS x, tile_y(p.y, 12) AS y,
               tile_xmin(tile_x(p.x, 12), 12) AS xmin, tile_ymax(tile_y(p.y, 12), 12) AS ymax,
               boxes_intersect(0D, 0D, 1D, 1D, p.x, p.y, p.x + 200, p.y) AS hit,
               round(raster_zoom(p.y, 2000), 6) AS zoom
        FROM {points}
        """,
        points=_centres(spark, sf),
    )


TILE_FUNCTIONS = f"""WITH {ctes('fx_footprints')},
p AS (SELECT id, degrees((xmin + xmax) / 2 / {R}) AS lon, degrees(atan(sinh((ymin + ymax) / 2 / {R}))) AS lat FROM fx_footprints),
t AS (SELECT id, lon, lat, 12 AS z, {tile_x('lon', 12)} AS x, {tile_y('lat', 12)} AS y FROM p)
SELECT id, x, y, txmin AS xmin, tymax AS ymax, (lon <= 1 AND lon + 200 >= 0 AND lat <= 1 AND lat >= 0) AS hit,
       round(log2(2 * {E} / (256 * (lat / 2000))), 6) AS zoom
FROM (SELECT *, {TILE_BOX} FROM t)"""


def tile_request_urls(spark, sf):
    tiles = tile_report.area_tiles(footprints(spark, sf), 14)
    box = T.tile_bbox("x", "y", "z")
    return tiles.select("z", "x", "y", T.bbox_text(box).alias("bbox"), T.tile_request_url(F.lit("imagery"), box).alias("url"))


REQUEST_URLS = with_area(14) + """,
txt AS (SELECT z, x, y, concat_ws(',', CAST(txmin AS VARCHAR), CAST(tymin AS VARCHAR), CAST(txmax AS VARCHAR), CAST(tymax AS VARCHAR)) AS bbox FROM tiles)
SELECT z, x, y, bbox, 'http://127.0.0.1/mapserv?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS=imagery&CRS=EPSG:3857&BBOX=' || bbox || '&WIDTH=256&HEIGHT=256&FORMAT=image/png' AS url FROM txt"""


def tile_range(spark, sf):
    return tile_report.covered_range(footprints(spark, sf), 16, by=("collection_id",)).select("collection_id", "range.*")


TILE_RANGE = f"""WITH {ctes('fx_footprints')}, {range_sql(16, 'collection_id')}
SELECT collection_id, x_min, x_max, y_min, y_max FROM rng"""


def tile_grid(spark, sf):
    return tile_report.area_tiles(footprints(spark, sf), 15, by=("collection_id",))


TILE_GRID = with_area(15, by="collection_id") + " SELECT collection_id, z, x, y FROM tiles"


def distinct_tiles(spark, sf):
    """Tiles under footprint centres, each once."""
    t = _centres(spark, sf).select(T.lonlat_to_tile("p.x", "p.y", F.lit(14)).alias("t")).select("t.*")
    return tilegen.distinct_tiles(t)


DISTINCT_TILES = f"""WITH {ctes('fx_footprints')},
p AS (SELECT degrees((xmin + xmax) / 2 / {R}) AS lon, degrees(atan(sinh((ymin + ymax) / 2 / {R}))) AS lat FROM fx_footprints)
SELECT DISTINCT 14 AS z, {tile_x('lon', 14)} AS x, {tile_y('lat', 14)} AS y FROM p"""


# --- join, hits, coverage, classes ------------------------------------------------------------


def tile_footprint_join(spark, sf):
    fp = footprints(spark, sf)
    return spatial.tile_footprint_join(tile_report.area_tiles(fp, 15), fp.select("id", "bbox"), 15).select("z", "x", "y", "id")


JOIN = with_area(15, pairs_sql()) + " SELECT z, x, y, id FROM pairs"


def tile_hits(spark, sf):
    fp = footprints(spark, sf)
    return spatial.tile_hits(tile_report.area_tiles(fp, 17), fp, 17)


HITS = with_area(17, pairs_sql()) + """,
counts AS (SELECT z, x, y, count(*) AS n, bool_or(xmin <= txmin AND ymin <= tymin AND xmax >= txmax AND ymax >= tymax) AS inside FROM pairs GROUP BY z, x, y)
SELECT z, x, y, coalesce(n, 0) AS cog_count, coalesce(inside, false) AS inside_one FROM tiles LEFT JOIN counts USING (z, x, y)"""


def tile_coverage(spark, sf):
    fp = footprints(spark, sf)
    return spatial.tile_coverage(tile_report.area_tiles(fp, 16), fp, 16).withColumn("coverage", F.round("coverage", 6))


COVERAGE = with_area(16, pairs_sql(), class_sql()) + """
SELECT z, x, y, round(coverage, 6) AS coverage FROM classes WHERE cog_count BETWEEN 1 AND 4 AND NOT inside_one"""


def classify_tiles(spark, sf):
    return tile_report.area_classes(footprints(spark, sf), 16).select("z", "x", "y", "class", "cog_count")


CLASSES = with_area(16, pairs_sql(), class_sql()) + " SELECT z, x, y, class, cog_count FROM classes"


def classify_tiles_by_collection(spark, sf):
    """Every collection measured on its own tiles."""
    classes = tile_report.area_classes(footprints(spark, sf), 15, by=("collection_id",))
    return classes.select("collection_id", "z", "x", "y", "class", "cog_count")


CLASSES_BY = with_area(15, pairs_sql("collection_id"), class_sql("collection_id"), by="collection_id") + (
    " SELECT collection_id, z, x, y, class, cog_count FROM classes"
)


def classify_tiles_polygons(spark, sf):
    """The polygon path on rings; the footprints are boxes, so box arithmetic gives the expected result."""
    fp = footprints(spark, sf).withColumn("ring", G.ring_from_bbox("bbox"))
    classes = tile_report.area_classes(fp, 15, ring="ring")
    return classes.select("z", "x", "y", "class", "cog_count", F.round("coverage", 6).alias("coverage"))


CLASSES_POLYGONS = with_area(15, pairs_sql(), class_sql()) + """
SELECT z, x, y, class, cog_count, round(coverage, 6) AS coverage FROM classes"""


def classify_tiles_native(spark, sf):
    """The footprints of every known system against tiles reprojected to it, each system on its own tiles."""
    web = P.with_web_copy(utm_boxes(spark, sf)).select("id", "epsg", "native_bbox", F.col("web_bbox").alias("bbox"))
    web = materialize(web, "web-boxes")  # read for the extent and the pairs of each system
    found = None
    for epsg in (26916, 26917):  # the codes of the footprints; of others there is no native geometry on the map
        one = web.where(F.col("epsg") == epsg)
        ranges = tile_report.covered_range(one, 15)
        classes = spatial.classify_range_native(ranges, one, 15, "native_bbox", "bbox", C.crs_literal(epsg))
        part = classes.select(F.lit(epsg).alias("epsg"), "z", "x", "y", "class", "cog_count")
        found = part if found is None else found.union(part)
    return found


def class_stats(spark, sf):
    fp = footprints(spark, sf)
    # One zoom after the other: as one query the driver holds the stages of all four and plans them anew after each.
    parts = [materialize(tile_report.area_report(fp, z).withColumn("zoom", F.lit(z)), f"class-stats-{z}") for z in (14, 15, 16, 17)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _stats_sql() -> str:
    one = "SELECT * FROM ({body} SELECT {stats}, {z} AS zoom FROM classes)"
    return " UNION ALL ".join(
        one.format(body=with_area(z, pairs_sql(), class_sql()), stats=STATS_SQL, z=z) for z in (14, 15, 16, 17)
    )


def usable_tiles(spark, sf):
    classes = tile_report.area_classes(footprints(spark, sf), 17)
    return spatial.usable_tiles(classes).select("z", "x", "y", "class", "cog_count")


USABLE = with_area(17, pairs_sql(), class_sql()) + (
    " SELECT z, x, y, class, cog_count FROM classes WHERE class IN ('interior', 'seam')"
)


def _located(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "location": F.concat(F.lit("/vsicurl/http://localhost:8001/"), F.col("key")),
            "tile_srs": F.concat(F.lit("EPSG:"), F.col("epsg").cast("string")),
        }
    )


def tile_read_plan(spark, sf):
    fp = _located(footprints(spark, sf))
    return spatial.tile_read_plan(tile_report.area_tiles(fp, 16), fp, 16)


READ_PLAN = with_area(16) + """
SELECT z, x, y, key, '/vsicurl/http://localhost:8001/' || key AS location, 'EPSG:' || CAST(epsg AS VARCHAR) AS tile_srs
FROM tiles t JOIN fx_footprints f ON f.xmin <= t.txmax AND f.xmax >= t.txmin AND f.ymin <= t.tymax AND f.ymax >= t.tymin"""


def nested_read_plan(spark, sf):
    fp = _located(footprints(spark, sf))
    tiles = tile_report.area_tiles(fp, 16)
    plan = spatial.tile_read_plan(tiles, fp, 16)
    nested = spatial.nested_read_plan(plan, spatial.classify_tiles(tiles, fp, 16))
    keys = F.transform("files", lambda f: f["key"])
    return nested.select("z", "x", "y", F.size("files").alias("n_files"), F.array_join(keys, "|").alias("keys"))


NESTED_PLAN = with_area(16, pairs_sql(), class_sql()) + """
SELECT z, x, y, CAST(count(*) AS INT) AS n_files, string_agg(key, '|' ORDER BY key) AS keys
FROM pairs JOIN classes USING (z, x, y) WHERE class IN ('interior', 'seam') GROUP BY z, x, y"""


# --- samples ----------------------------------------------------------------------------------

SEED, WANTED, SAMPLE_ZOOM = 7, 40, 16


def _draws(spark, sf):
    fp = footprints(spark, sf)
    return tilegen.classify_draws(tile_report.covered_range(fp, SAMPLE_ZOOM), fp, SAMPLE_ZOOM, WANTED, SEED)


def sample_tiles(spark, sf):
    """Drawn in rounds until enough are usable."""
    fp = footprints(spark, sf)
    draws = tilegen.classify_in_rounds(tile_report.covered_range(fp, SAMPLE_ZOOM), fp, SAMPLE_ZOOM, WANTED, SEED)
    return tilegen.sample_tiles(draws, WANTED)


def sample_stats(spark, sf):
    return tilegen.sample_stats(_draws(spark, sf), WANTED)


def _draw(low: str, high: str, salt: str) -> str:
    return f"CAST({low} + ('0x' || substr(md5('{SEED}:{salt}:' || attempt), 1, 12))::BIGINT % ({high} - {low} + 1) AS INT)"


ATTEMPTS = tilegen.max_attempts(WANTED)
SAMPLE_BASE = f"""WITH {ctes('fx_footprints')}, {range_sql(SAMPLE_ZOOM)},
attempts AS (SELECT z, x_min, x_max, y_min, y_max, CAST(unnest(generate_series(1, {ATTEMPTS})) AS INT) AS attempt FROM rng),
drawn AS (SELECT z, {_draw('x_min', 'x_max', 'x')} AS x, {_draw('y_min', 'y_max', 'y')} AS y, attempt FROM attempts),
firsts AS (SELECT z, x, y, min(attempt) AS attempt FROM drawn GROUP BY z, x, y),
tiles AS (SELECT *, {TILE_BOX} FROM firsts), {pairs_sql()}, {class_sql()}"""
SAMPLE = SAMPLE_BASE + f"""
SELECT z, x, y, class, cog_count, attempt FROM classes JOIN firsts USING (z, x, y)
WHERE class IN ('interior', 'seam') ORDER BY attempt LIMIT {WANTED}"""
SAMPLE_STATS = SAMPLE_BASE + f"""
SELECT {ATTEMPTS}::BIGINT AS attempts, {WANTED}::BIGINT AS requested,
 least(count(*) FILTER (WHERE class IN ('interior', 'seam')), {WANTED}) AS generated,
 count(*) FILTER (WHERE class = 'empty') AS empty, count(*) FILTER (WHERE class = 'interior') AS interior,
 count(*) FILTER (WHERE class = 'seam') AS seam, count(*) FILTER (WHERE class = 'partial') AS partial,
 count(*) FILTER (WHERE class = 'too_many') AS too_many, {ATTEMPTS} - count(*) AS duplicates FROM classes"""


PIXELS = 1000  # width of the footprints' rasters


def prepared_tiles(spark, sf):
    """Zoom from the data's own native zoom, then a sample with request addresses."""
    fp = footprints(spark, sf)
    zooms = fp.withColumns({"id": F.lit("all"), "native_zoom": T.native_zoom("bbox", F.lit(PIXELS))})
    entry = P.median_native_zoom(zooms, ("id",))
    return tile_report.prepare_collection(entry, "all", fp, WANTED, SEED).select("z", "x", "y", "class", "url")


NATIVE = f"""(SELECT CAST(round_even(zoom, 0) AS INT) FROM (SELECT zoom, row_number() OVER (ORDER BY zoom) - 1 AS i, count(*) OVER () AS n
 FROM (SELECT log2(2 * {E} / (256 * ((xmax - xmin) / {PIXELS}))) AS zoom FROM fx_footprints)) WHERE i = n // 2)"""
PREPARED = SAMPLE_BASE.replace(range_sql(SAMPLE_ZOOM), range_sql(NATIVE)) + f""",
picked AS (SELECT z, x, y, class, attempt FROM classes JOIN firsts USING (z, x, y) WHERE class IN ('interior', 'seam') ORDER BY attempt LIMIT {WANTED}),
pb AS (SELECT *, {TILE_BOX} FROM picked)
SELECT z, x, y, class, 'http://127.0.0.1/mapserv?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS=imagery&CRS=EPSG:3857&BBOX=' ||
 concat_ws(',', CAST(txmin AS VARCHAR), CAST(tymin AS VARCHAR), CAST(txmax AS VARCHAR), CAST(tymax AS VARCHAR)) ||
 '&WIDTH=256&HEIGHT=256&FORMAT=image/png' AS url FROM pb"""


# --- window queries ---------------------------------------------------------------------------

WINDOW = (-9495000.0, 4505000.0, -9480000.0, 4520000.0)
IN_WINDOW = f"xmin <= {WINDOW[2]} AND xmax >= {WINDOW[0]} AND ymin <= {WINDOW[3]} AND ymax >= {WINDOW[1]}"


def bbox_window(spark, sf):
    found = spatial.bbox_window(footprints(spark, sf), WINDOW, max_rows=None)
    return unboxed(found).select("id", "key", "xmin", "ymin", "xmax", "ymax")


BBOX_WINDOW = f"WITH {ctes('fx_footprints')} SELECT id, key, xmin, ymin, xmax, ymax FROM fx_footprints WHERE {IN_WINDOW}"


def bbox_window_polygons(spark, sf):
    fp = footprints(spark, sf).withColumn("ring", G.ring_from_bbox("bbox"))
    return spatial.bbox_window(fp, WINDOW, ring="ring", max_rows=None).select("id", "key")


def feature_cap(spark, sf):
    """A window request answers with at most 50,000 features, here in id order."""
    return spatial.bbox_window(footprints(spark, sf), WINDOW, max_rows=50_000, order="id").select("id", "key")


FEATURE_CAP = f"WITH {ctes('fx_footprints')} SELECT id, key FROM fx_footprints WHERE {IN_WINDOW} ORDER BY id LIMIT 50000"


def feature_cap_binds(spark, sf):
    """More than 50,000 features meet the window (at scale 0.01 and above): the first ones in key order."""
    parcels = boxed(derive(spark, sf, PARCELS))
    return spatial.bbox_window(parcels, PARCEL_WINDOW, max_rows=50_000, order="id").select("id", "key")


PARCELS = """SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS id, concat('parcel/', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS key,
 CAST(l_partkey % 1000 AS DOUBLE) AS xmin, CAST(l_suppkey AS DOUBLE) AS ymin, CAST(l_partkey % 1000 + l_linenumber AS DOUBLE) AS xmax, CAST(l_suppkey + 1 AS DOUBLE) AS ymax FROM lineitem"""
PARCEL_WINDOW = (5.0, 0.0, 1e9, 1e9)
FEATURE_CAP_BINDS = f"SELECT id, key FROM ({PARCELS}) WHERE xmax >= 5 ORDER BY id LIMIT 50000".replace("AS STRING", "AS VARCHAR")


def label_points(spark, sf):
    fp = footprints(spark, sf).withColumns({"file_name": F.element_at(F.split("key", "/"), -1), "location": F.col("key")})
    few = spatial.bbox_window(fp, WINDOW, max_rows=None)
    found = spatial.label_points(few).withColumn("view", F.lit("window"))
    for c in range(4):  # the collections of the footprints
        one = spatial.label_points(fp.where(F.col("collection_id") == f"c{c}"))
        found = found.union(one.withColumn("view", F.lit(f"c{c}")))
    return found


LABELS = f"""WITH {ctes('fx_footprints')},
named AS (SELECT *, regexp_extract(key, '[^/]*$') AS label, (xmin + xmax) / 2 AS label_x, (ymin + ymax) / 2 AS label_y FROM fx_footprints),
few AS (SELECT * FROM named WHERE {IN_WINDOW}), many AS (SELECT *, count(*) OVER (PARTITION BY collection_id) AS n FROM named)
SELECT key, label, label_x, label_y, 'window' AS view FROM few WHERE (SELECT count(*) FROM few) <= 500
UNION ALL SELECT key, label, label_x, label_y, collection_id AS view FROM many WHERE n <= 500"""


QUERIES = {
    "tile_math": (tile_math, TILE_MATH),
    "tile_functions_sql": (tile_functions_sql, TILE_FUNCTIONS),
    "tile_request_urls": (tile_request_urls, REQUEST_URLS),
    "tile_range": (tile_range, TILE_RANGE),
    "tile_grid": (tile_grid, TILE_GRID),
    "distinct_tiles": (distinct_tiles, DISTINCT_TILES),
    "tile_footprint_join": (tile_footprint_join, JOIN),
    "tile_hits": (tile_hits, HITS),
    "tile_coverage": (tile_coverage, COVERAGE),
    "classify_tiles": (classify_tiles, CLASSES),
    "classify_tiles_by_collection": (classify_tiles_by_collection, CLASSES_BY),
    "classify_tiles_polygons": (classify_tiles_polygons, CLASSES_POLYGONS),
    "classify_tiles_native": (classify_tiles_native, None),
    "class_stats": (class_stats, _stats_sql()),
    "usable_tiles": (usable_tiles, USABLE),
    "tile_read_plan": (tile_read_plan, READ_PLAN),
    "nested_read_plan": (nested_read_plan, NESTED_PLAN),
    "sample_tiles": (sample_tiles, SAMPLE),
    "sample_stats": (sample_stats, SAMPLE_STATS),
    "prepared_tiles": (prepared_tiles, PREPARED),
    "bbox_window": (bbox_window, BBOX_WINDOW),
    "bbox_window_polygons": (bbox_window_polygons, f"WITH {ctes('fx_footprints')} SELECT id, key FROM fx_footprints WHERE {IN_WINDOW}"),
    "feature_cap": (feature_cap, FEATURE_CAP),
    "feature_cap_binds": (feature_cap_binds, FEATURE_CAP_BINDS),
    "label_points": (label_points, LABELS),
}
