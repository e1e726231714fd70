"""Catalog algebra on the catalog derived from the parts table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import derive, fixture
from ..functions import geometry as G
from ..functions import text as X
from ..functions import tiles as T
from ..operators import catalog as K
from ..operators import tilegen
from ..session import scratch_path
from ..sinks import writers
from ..sources import readers
from .common import ctes

NUMBER = "CAST(substr(id, 7) AS INT)"
# A fuller catalog: some brands have extents, groups, sources; some have none.
FULL_SQL = f"""SELECT {NUMBER} AS position, id, cog_count, CASE WHEN {NUMBER} % 5 = 0 THEN NULL ELSE draw_order END AS draw_order, enabled,
 CASE WHEN {NUMBER} % 4 = 0 THEN NULL ELSE CAST({NUMBER} * 1000 AS DOUBLE) END AS edge, CAST(26910 + {NUMBER} % 6 AS INT) AS native_epsg,
 {NUMBER} % 3 = 0 AS parquet, {NUMBER} % 2 = 0 AS postgis FROM fx_catalog"""


def collections(spark, sf):
    """Typed catalog rows, round-tripped through the open ``fields`` map."""
    return K.typed(_catalog(spark, sf))


def _catalog(spark, sf):
    base = fixture(spark, sf, "fx_catalog")
    base.createOrReplaceTempView("fx_catalog")
    rows = spark.sql(FULL_SQL)
    e, n = F.col("edge"), F.col("position")
    group = [F.struct((F.col("native_epsg") + i).alias("epsg"), F.concat(F.lit("/idx/"), "id", F.lit(f"_{i}.fgb")).alias("tileindex"), F.concat_ws("-", "id", F.lit(str(i))).alias("layer_name")) for i in (0, 1)]
    return K.untyped(
        rows.select(
            "position", "id", "cog_count", "draw_order", "enabled", "native_epsg", "parquet", "postgis",
            F.when(e.isNotNull(), F.array(e, -e, e + 500, 500 - e)).alias("extent_3857"),
            F.when(e.isNotNull(), F.array(n / 8.0, n / 4.0, n / 8.0 + 2, n / 4.0 + 1)).alias("bbox_4326"),
            F.when(n % 4 == 1, F.array(*group)).when(n % 4 == 2, F.array(group[0])).alias("tileindexes"),
            F.when(n % 4 == 3, F.concat(F.lit("/idx/"), "id", F.lit(".fgb"))).alias("tileindex"),
            F.when(n % 6 == 1, F.array(F.lit("BANDS=1"), F.lit("SCALE=0,65535"))).alias("raster_processing"),
            F.when(n % 7 == 1, F.lit("Survey")).alias("attribution"),
            F.when(n % 5 == 1, F.lit(17)).alias("native_zoom"),
            F.when(n % 5 == 2, F.lit("2024-01-01T00:00:00Z")).when(n % 5 == 3, F.lit("yesterday")).alias("indexed_at"),
        )
    )


FULL = f"WITH {ctes('fx_catalog')}, cat AS ({FULL_SQL})"


def enabled_order(spark, sf):
    return K.in_draw_order(K.enabled_collections(collections(spark, sf))).withColumn(
        "draw_order", F.coalesce("draw_order", F.lit(10))
    ).select("id", "draw_order", "position")


ENABLED = FULL + " SELECT id, coalesce(draw_order, 10) AS draw_order, position::BIGINT AS position FROM cat WHERE coalesce(enabled, true) ORDER BY 2, 3"


def active_pick(spark, sf):
    c = collections(spark, sf)
    picks = [
        ("default", K.active_collection(c)),
        ("configured", K.active_collection(c, configured="Brand#7", explicit="Brand#9")),
        ("explicit", K.active_collection(c, configured="gone", explicit="Brand#9")),
        ("none enabled", K.active_collection(c.withColumn("enabled", F.lit(False)))),
    ]
    out = None
    for case, df in picks:
        row = df.select(F.lit(case).alias("rule"), "id")
        out = row if out is None else out.union(row)
    return out


ACTIVE = FULL + """ SELECT 'default' AS rule, (SELECT id FROM cat WHERE coalesce(enabled, true) ORDER BY coalesce(draw_order, 10), position LIMIT 1) AS id
UNION ALL SELECT 'configured', id FROM cat WHERE id = 'Brand#7' UNION ALL SELECT 'explicit', id FROM cat WHERE id = 'Brand#9'
UNION ALL SELECT 'none enabled', (SELECT id FROM cat ORDER BY position LIMIT 1)"""


def catalog_extent(spark, sf):
    some = K.catalog_extent(collections(spark, sf)).withColumn("which", F.lit("enabled"))
    none = K.catalog_extent(collections(spark, sf).withColumn("extent_3857", F.lit(None).cast("array<double>"))).withColumn("which", F.lit("none"))
    return some.union(none)


EXTENT = FULL + """ SELECT min(edge) AS xmin, min(-edge) AS ymin, max(edge + 500) AS xmax, max(500 - edge) AS ymax, 'enabled' AS which FROM cat WHERE coalesce(enabled, true) AND edge IS NOT NULL
UNION ALL SELECT -14000000::DOUBLE, 2500000::DOUBLE, -7000000::DOUBLE, 6000000::DOUBLE, 'none'"""


def srs_set(spark, sf):
    return K.srs_set(collections(spark, sf))


SRS = FULL + """ SELECT DISTINCT epsg FROM (SELECT 3857 AS epsg UNION ALL SELECT 4326 UNION ALL SELECT native_epsg FROM cat WHERE coalesce(enabled, true)
 UNION ALL SELECT native_epsg + 1 FROM cat WHERE coalesce(enabled, true) AND position % 4 = 1)"""


def collection_groups(spark, sf):
    g = K.collection_groups(collections(spark, sf))
    return g.select("id", "epsg", "tileindex", "tileindex_layer_name", "layer_name", "index_layer", "tileitem", "mixed_srs", F.array_join("processing", ";").alias("processing"))


GROUPS = FULL + """, g AS (SELECT id, position, native_epsg AS epsg, 0 AS i FROM cat UNION ALL SELECT id, position, native_epsg + 1, 1 FROM cat WHERE position % 4 = 1),
t AS (SELECT *, CASE WHEN position % 4 IN (1, 2) THEN '/idx/' || id || '_' || i || '.fgb' WHEN position % 4 = 3 THEN '/idx/' || id || '.fgb' END AS tileindex FROM g)
SELECT id, epsg, tileindex, regexp_extract(tileindex, '([^/]*)\\.fgb$', 1) AS tileindex_layer_name, CASE WHEN position % 4 IN (1, 2) THEN id || '-' || i ELSE id END AS layer_name,
 'cog-tileindex-' || id || CASE WHEN position % 4 = 1 THEN '-' || epsg ELSE '' END AS index_layer, 'location' AS tileitem, false AS mixed_srs,
 CASE WHEN position % 6 = 1 THEN 'BANDS=1;SCALE=0,65535' ELSE 'BANDS=1,2,3;RESAMPLE=AVERAGE' END AS processing FROM t"""


def _entries(spark, sf):
    """Rescan results: every second brand again, and new collections per part type."""
    again = fixture(spark, sf, "fx_catalog").where("CAST(substr(id, 7) AS INT) % 2 = 0").select(
        F.expr("CAST(substr(id, 7) AS BIGINT)").alias("position"), "id", (F.col("cog_count") + 1000).alias("cog_count"), F.lit(True).alias("postgis")
    )
    fresh = derive(spark, sf, "SELECT p_type AS id, count(*) AS cog_count FROM part GROUP BY p_type").select(
        (F.row_number().over(W.orderBy("id")) + 100).cast("bigint").alias("position"), "id", "cog_count", F.lit(False).alias("postgis")
    )
    return K.untyped(again.union(fresh))


def catalog_upsert(spark, sf):
    """Shallow merge: entry keys win, other keys survive, new collections follow."""
    merged = K.typed(K.upsert_catalog(_catalog(spark, sf), _entries(spark, sf)))
    placed = merged.withColumn("place", F.row_number().over(W.orderBy("position")))
    return placed.select("id", "place", "cog_count", "postgis", "draw_order", "native_epsg", "attribution")


UPSERT = FULL + """, again AS (SELECT id, cog_count + 1000 AS cog_count, true AS postgis FROM fx_catalog WHERE CAST(substr(id, 7) AS INT) % 2 = 0),
fresh AS (SELECT p_type AS id, count(*) AS cog_count, false AS postgis FROM part GROUP BY p_type),
m AS (SELECT c.id, position AS o1, '' AS o2, coalesce(a.cog_count, c.cog_count) AS cog_count, coalesce(a.postgis, c.postgis) AS postgis, draw_order, native_epsg,
  CASE WHEN position % 7 = 1 THEN 'Survey' END AS attribution FROM cat c LEFT JOIN again a USING (id)
  UNION ALL SELECT id, 1000, id, cog_count, postgis, NULL, NULL, NULL FROM fresh)
SELECT id, CAST(row_number() OVER (ORDER BY o1, o2) AS INT) AS place, cog_count, postgis, draw_order, native_epsg, attribution FROM m"""


def catalog_document(spark, sf):
    """Written as a document, merged with rescan entries on disk, one collection deleted, read again."""
    path = scratch_path(spark, "catalog") + ".json"
    writers.write_catalog(_catalog(spark, sf), path)
    writers.upsert_catalog_document(_entries(spark, sf), path)
    left = K.delete_collection(readers.read_catalog(spark, path), "Brand#8")
    return K.typed(left).select("id", "cog_count", "postgis", "native_epsg", F.size("raster_processing").alias("steps"))


DOCUMENT = FULL + """, again AS (SELECT id, cog_count + 1000 AS cog_count, true AS postgis FROM fx_catalog WHERE CAST(substr(id, 7) AS INT) % 2 = 0)
SELECT c.id, coalesce(a.cog_count, c.cog_count) AS cog_count, coalesce(a.postgis, c.postgis) AS postgis, native_epsg, CASE WHEN position % 6 = 1 THEN 2 END AS steps
FROM cat c LEFT JOIN again a USING (id) WHERE c.id <> 'Brand#8'
UNION ALL SELECT p_type, count(*), false, NULL, NULL FROM part GROUP BY p_type"""

NOW = "2024-01-03 05:00:00"


def catalog_to_ui(spark, sf):
    u = K.catalog_to_ui(collections(spark, sf), F.lit(NOW).cast("timestamp"))
    return u.select("collectionName", "layerName", "enabled", "drawOrder", "status", "source.label", "source.region", "source.accessMode", "source.requesterPays", F.array_join("layerNames", ",").alias("layerNames"))


STATUS = """concat_ws(' · ', format('{:,}', cog_count) || ' COGs', CASE WHEN position % 5 = 2 THEN 'indexed 2d ago' WHEN position % 5 = 3 THEN 'indexed yesterday' END,
 CASE WHEN postgis THEN 'postgis' WHEN parquet THEN 'geoparquet' END)"""
UI = FULL + f""" SELECT id AS "collectionName", id AS "layerName", coalesce(enabled, true) AS enabled, coalesce(draw_order, 10) AS "drawOrder", {STATUS} AS status,
 id AS label, 'us-west-2' AS region, 'unsigned' AS "accessMode", false AS "requesterPays", id AS "layerNames" FROM cat"""


def catalog_to_viewer(spark, sf):
    v = K.catalog_to_viewer(collections(spark, sf))
    return v.select(
        "collectionId", "mapName", "layerName", "imageryMinZoom", "nativeZoom", "attribution",
        F.col("bounds")[0][0].alias("min_lat"), F.col("bounds")[1][1].alias("max_lon"), F.col("center")[0].alias("center_lat"), F.col("center")[1].alias("center_lon"),
    )


VIEWER = FULL + """ SELECT id AS "collectionId", 'imagery' AS "mapName", id AS "layerName", 14 AS "imageryMinZoom", CASE WHEN position % 5 = 1 THEN 17 ELSE 18 END AS "nativeZoom",
 CASE WHEN position % 7 = 1 THEN 'Survey' ELSE '' END AS attribution, CASE WHEN edge IS NULL THEN 37::DOUBLE ELSE position / 4::DOUBLE END AS min_lat,
 CASE WHEN edge IS NULL THEN -73::DOUBLE ELSE position / 8::DOUBLE + 2 END AS max_lon, CASE WHEN edge IS NULL THEN 39.5::DOUBLE ELSE position / 4::DOUBLE + 0.5::DOUBLE END AS center_lat,
 CASE WHEN edge IS NULL THEN -82::DOUBLE ELSE position / 8::DOUBLE + 1 END AS center_lon FROM cat"""


def backend_summary(spark, sf):
    """What would serve each collection if it were the active one, with and without a database."""
    c = collections(spark, sf)
    out = K.backend_summary(c, True).withColumn("database", F.lit(True)).union(K.backend_summary(c, False).withColumn("database", F.lit(False)))
    return out.select("activeCollection", "backend", "cogCount", F.array_join(F.transform("nativeEpsgs", lambda e: e.cast("string")), ",").alias("nativeEpsgs"), "indexSource", "database")


BACKEND = FULL + """, d AS (SELECT *, true AS database FROM cat UNION ALL SELECT *, false FROM cat)
SELECT id AS "activeCollection", CASE WHEN database AND postgis THEN 'PostGIS' WHEN parquet THEN 'GeoParquet' ELSE 'FlatGeobuf' END AS backend, cog_count AS "cogCount",
 native_epsg::VARCHAR AS "nativeEpsgs", CASE WHEN database AND postgis THEN 'cog_index' WHEN position % 4 = 1 THEN id || '_0.fgb, ' || id || '_1.fgb'
 WHEN position % 4 = 2 THEN id || '_0.fgb' WHEN position % 4 = 3 THEN id || '.fgb' ELSE '' END AS "indexSource", database FROM d"""


def tiles_of_collection(spark, sf):
    """Collection bounds -> tile range -> all tiles, each collection at its own zoom; the tiles of a collection in figures."""
    c = collections(spark, sf).select(
        "id", G.bounds_from_bbox(G.bbox_from_array("bbox_4326")).alias("bounds"), T.resolve_zoom(F.lit(None), "native_zoom", F.lit(0)).alias("zoom"),
    )
    tiles = tilegen.tiles_of_collection(c, "zoom")
    x, y = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    return tiles.groupBy("collection_id", "z").agg(
        F.count(F.lit(1)).alias("tiles"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y"), F.sum((x * 31 + y) % 1009).alias("mixed"),
    )


def _tiles_sql() -> str:
    """Counts and sums in closed form; the mixed sum row by row, from the number of times each remainder of y occurs."""
    from .spatial import tile_x, tile_y

    return FULL + f""", b AS (SELECT id, CASE WHEN position % 5 = 1 THEN 17 ELSE 18 END AS z, CASE WHEN edge IS NULL THEN -90 ELSE position / 8::DOUBLE END AS lon0,
 CASE WHEN edge IS NULL THEN -73 ELSE position / 8::DOUBLE + 2 END AS lon1, CASE WHEN edge IS NULL THEN 37 ELSE position / 4::DOUBLE END AS lat0,
 CASE WHEN edge IS NULL THEN 42 ELSE position / 4::DOUBLE + 1 END AS lat1 FROM cat),
r AS (SELECT id, z, {tile_x('lon0', 'z')}::BIGINT AS x0, {tile_x('lon1', 'z')}::BIGINT AS x1, {tile_y('lat1', 'z')}::BIGINT AS y0, {tile_y('lat0', 'z')}::BIGINT AS y1 FROM b),
ry AS (SELECT id, y % 1009 AS my, count(*) AS ny FROM (SELECT id, unnest(generate_series(y0, y1)) AS y FROM r) GROUP BY 1, 2),
rx AS (SELECT id, (x * 31) % 1009 AS mx, count(*) AS nx FROM (SELECT id, unnest(generate_series(x0, x1)) AS x FROM r) GROUP BY 1, 2),
mix AS (SELECT id, sum(nx * ny * ((mx + my) % 1009)) AS mixed FROM rx JOIN ry USING (id) GROUP BY id)
SELECT id AS collection_id, z, (x1 - x0 + 1) * (y1 - y0 + 1) AS tiles, x0::INT AS x_min, x1::INT AS x_max, y0::INT AS y_min, y1::INT AS y_max,
 CAST((x0 + x1) * (x1 - x0 + 1) / 2 * (y1 - y0 + 1) AS BIGINT) AS sum_x, CAST((y0 + y1) * (y1 - y0 + 1) / 2 * (x1 - x0 + 1) AS BIGINT) AS sum_y, CAST(mixed AS BIGINT) AS mixed
FROM r JOIN mix USING (id)"""


def text_rules(spark, sf):
    """Slugs, ids, prefixes, names and missing fields on every part."""
    p = derive(spark, sf, "SELECT p_partkey, p_name, p_brand, p_type FROM part")
    slug = X.slugify(F.concat_ws(" / ", "p_name", "p_brand"))
    uri = F.concat(F.lit("s3://"), "p_type", F.lit("/a/"), F.col("p_partkey").cast("string"))
    given = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("prefix"))).otherwise(F.array(F.lit("bucket"), F.lit("collection_id")))
    return p.select(
        "p_partkey", slug.alias("slug"), X.is_collection_id(slug).alias("slug_ok"), X.is_collection_id("p_brand").alias("brand_ok"),
        X.normalize_prefix(F.concat(uri, F.lit("//"))).alias("prefix"), X.split_s3_uri(uri)["key"].alias("key"),
        X.file_name(uri).alias("file_name"), F.array_join(X.missing_fields(given), ",").alias("missing"),
        X.layer_name(slug, F.lit(26917), F.col("p_partkey") % 3).alias("layer"),
        X.age_text(F.lit("2024-01-01T00:00:00Z"), F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 61)).alias("age"),
    )


TEXT_RULES = """WITH p AS (SELECT *, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9-]+', '-', 'g'), '-') AS slug, 61 * p_partkey AS s FROM part)
SELECT p_partkey, slug, true AS slug_ok, false AS brand_ok, p_type || '/a/' || p_partkey || '/' AS prefix, 'a/' || p_partkey AS key, p_partkey::VARCHAR AS file_name,
 CASE WHEN p_partkey % 3 = 0 THEN 'bucket,collection_id' ELSE 'prefix' END AS missing, slug || CASE WHEN p_partkey % 3 = 2 THEN '-26917' ELSE '' END AS layer,
 CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age FROM p"""

QUERIES = {
    "enabled_order": (enabled_order, ENABLED),
    "active_pick": (active_pick, ACTIVE),
    "catalog_extent": (catalog_extent, EXTENT),
    "srs_set": (srs_set, SRS),
    "collection_groups": (collection_groups, GROUPS),
    "catalog_upsert": (catalog_upsert, UPSERT),
    "catalog_document": (catalog_document, DOCUMENT),
    "catalog_to_ui": (catalog_to_ui, UI),
    "catalog_to_viewer": (catalog_to_viewer, VIEWER),
    "backend_summary": (backend_summary, BACKEND),
    "tiles_of_collection": (tiles_of_collection, _tiles_sql()),
    "text_rules": (text_rules, TEXT_RULES),
}
