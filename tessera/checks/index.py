"""Footprint building, CRS handling, per-collection facts and index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import derive, fixture
from ..functions import crs as C
from ..functions import geometry as G
from ..functions import text as X
from ..functions import tiles as T
from ..operators import footprints as P
from ..operators import ranks, spatial, staging
from ..plans import scan
from ..session import scratch_path
from ..sinks import writers
from ..sources import readers
from .common import E, R, ctes, footprints, lake, unboxed, utm_boxes

WKT_SQL = """CASE WHEN id % 9 = 0 THEN 'PROJCS["unnamed",GEOGCS["NAD83",AUTHORITY["EPSG","4269"]],UNIT["metre",1]]'
 ELSE concat('PROJCS["x",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","', CAST(CASE WHEN id % 7 = 0 THEN 3395 ELSE 3857 END AS STRING), '"]]') END"""


def headers(spark, sf):
    base = fixture(spark, sf, "fx_headers")
    return base.select(
        "id", F.lit("imagery").alias("bucket"), "key", F.expr(WKT_SQL).alias("wkt"),
        F.array(*[f"gt{i}" for i in range(6)]).alias("gt"), "width", "height", "bands", "data_type",
    )


def _built(spark, sf):
    return P.build_footprints(headers(spark, sf), F.concat(F.lit("c"), F.regexp_extract("key", r"(\d)\.tif$", 1)))


def footprint_from_header(spark, sf):
    fp = _built(spark, sf)
    return unboxed(
        fp.select(
            "key", "collection_id", "file_name", "location", "epsg", "data_type",
            F.round("native_zoom", 6).alias("native_zoom"), F.col("web_ring").isNotNull().alias("has_web"),
            G.ring_to_wkt("native_ring").alias("wkt"), "native_bbox",
        ),
        "native_bbox",
    )


HEADERS = f"""WITH {ctes('fx_headers')},
h AS (SELECT *, {WKT_SQL} AS wkt_text,
  least(gt0, gt0 + gt1 * width + gt2 * height) AS xmin, greatest(gt0, gt0 + gt1 * width + gt2 * height) AS xmax,
  least(gt3, gt3 + gt4 * width + gt5 * height) AS ymin, greatest(gt3, gt3 + gt4 * width + gt5 * height) AS ymax FROM fx_headers),
c AS (SELECT *, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 7 = 0 THEN 3395 ELSE 3857 END AS epsg FROM h),
f AS (SELECT *, epsg IS NOT NULL AND epsg = 3857 AS has_web,
  CASE WHEN epsg = 3857 THEN log2(2 * {E} / (256 * ((xmax - xmin) / width))) END AS native_zoom FROM c)"""
FOOTPRINTS = HEADERS + """
SELECT key, 'c' || (id % 10) AS collection_id, regexp_extract(key, '[^/]*$') AS file_name,
 '/vsicurl/http://localhost:8001/standard/us-west-2/imagery/' || key AS location, epsg, data_type,
 round(native_zoom, 6) AS native_zoom, has_web,
 'POLYGON((' || xmin::VARCHAR || ' ' || ymin::VARCHAR || ', ' || xmax::VARCHAR || ' ' || ymin::VARCHAR || ', ' || xmax::VARCHAR || ' ' || ymax::VARCHAR
   || ', ' || xmin::VARCHAR || ' ' || ymax::VARCHAR || ', ' || xmin::VARCHAR || ' ' || ymin::VARCHAR || '))' AS wkt,
 xmin, ymin, xmax, ymax FROM f"""


def native_zoom(spark, sf):
    fp = _built(spark, sf).where("native_zoom IS NOT NULL")
    native = F.bround("native_zoom").cast("int")
    zooms = T.zoom_range(native)
    return fp.select(
        "key", native.alias("native_zoom"), zooms["min_zoom"].alias("min_zoom"), zooms["max_zoom"].alias("max_zoom"),
        T.zoom_relation(F.lit(14), native).alias("at_14"),
        T.resolve_zoom(F.lit(None), F.when(F.col("width") > 0, native - 13), F.lit(15)).alias("resolved"),
    )


NATIVE_ZOOM = HEADERS + """, n AS (SELECT key, CAST(round_even(native_zoom, 0) AS INT) AS native_zoom FROM f WHERE has_web)
SELECT key, native_zoom, native_zoom - 4 AS min_zoom, native_zoom + 1 AS max_zoom,
 CASE WHEN native_zoom = 14 THEN 'native' WHEN native_zoom < 14 THEN '+' || (14 - native_zoom) || ' · upsampled' ELSE (14 - native_zoom) || ' · downsampled' END AS at_14,
 coalesce(nullif(native_zoom - 13, 0), 15) AS resolved FROM n"""


def median_zoom(spark, sf):
    return P.median_native_zoom(_built(spark, sf))


MEDIAN_ZOOM = HEADERS + """, r AS (SELECT 'c' || (id % 10) AS collection_id, native_zoom,
  row_number() OVER (PARTITION BY id % 10 ORDER BY native_zoom) - 1 AS i, count(*) OVER (PARTITION BY id % 10) AS n FROM f WHERE native_zoom IS NOT NULL)
SELECT c.collection_id, coalesce(CAST(round_even(r.native_zoom, 0) AS INT), 18) AS native_zoom
FROM (SELECT DISTINCT 'c' || (id % 10) AS collection_id FROM f) c LEFT JOIN r ON r.collection_id = c.collection_id AND r.i = r.n // 2"""


# --- CRS --------------------------------------------------------------------------------------


# The system of a UTM code, from the ellipsoid and the published series; nothing is taken from the operator.
UTM_PARAMS = """SELECT epsg, radians((epsg - 26900) * 6 - 183) AS l0, 0.9996::DOUBLE * 6378137 * (1 + n * n / 4 + n * n * n * n / 64) / (1 + n) AS sc,
 n / 2 - n * n * 2 / 3 + n * n * n * 37 / 96 - n * n * n * n / 360 AS b1, n * n / 48 + n * n * n / 15 - n * n * n * n * 437 / 1440 AS b2,
 n * n * n * 17 / 480 - n * n * n * n * 37 / 840 AS b3, n * n * n * n * 4397 / 161280 AS b4,
 2 * n - n * n * 2 / 3 - 2 * n * n * n + n * n * n * n * 116 / 45 AS d1, n * n * 7 / 3 - n * n * n * 8 / 5 - n * n * n * n * 227 / 45 AS d2,
 n * n * n * 56 / 15 - n * n * n * n * 136 / 35 AS d3, n * n * n * n * 4279 / 630 AS d4
 FROM (SELECT unnest([26916, 26917]) AS epsg, (1 / 298.257222101::DOUBLE) / (2 - 1 / 298.257222101::DOUBLE) AS n)"""


def _sum(name: str, f: str, g: str) -> str:
    return " + ".join(f"{name}{j} * {f}({2 * j} * u) * {g}({2 * j} * v)" for j in (1, 2, 3, 4))


REPROJECTED = f"""WITH {ctes('fx_utm')}, crs AS ({UTM_PARAMS}),
corners AS (SELECT id, epsg, 1 AS i, xmin AS px, ymin AS py FROM fx_utm UNION ALL SELECT id, epsg, 2, xmax, ymin FROM fx_utm
  UNION ALL SELECT id, epsg, 3, xmax, ymax FROM fx_utm UNION ALL SELECT id, epsg, 4, xmin, ymax FROM fx_utm),
a AS (SELECT id, i, c.*, py / sc AS u, (px - 500000) / sc AS v FROM corners JOIN crs c USING (epsg)),
b AS (SELECT *, u - ({_sum('b', 'sin', 'cosh')}) AS up, v - ({_sum('b', 'cos', 'sinh')}) AS vp FROM a),
g AS (SELECT *, l0 + atan2(sinh(vp), cos(up)) AS lon, asin(sin(up) / cosh(vp)) AS chi FROM b),
w AS (SELECT id, i, {R} * lon AS x,
  {R} * asinh(tan(chi + d1 * sin(2 * chi) + d2 * sin(4 * chi) + d3 * sin(6 * chi) + d4 * sin(8 * chi))) AS y FROM g)"""


def reproject_rings(spark, sf):
    fp = P.with_web_copy(utm_boxes(spark, sf))
    corner = F.posexplode(F.slice("web_ring", 1, 4)).alias("i", "p")
    return fp.select("id", corner).select(
        "id", (F.col("i") + 1).alias("i"), F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y")
    )


def reproject_boxes(spark, sf):
    fp = utm_boxes(spark, sf).withColumn("b", F.col("native_bbox"))
    moved = C.with_crs(fp).select("id", C.reproject_bbox("b", "crs", C.crs_literal(3857)).alias("bbox"))
    rounded = moved.where("bbox IS NOT NULL").select("id", G.round_bbox("bbox", 3).alias("bbox"))
    return unboxed(rounded)


REPROJECTED_BOXES = REPROJECTED + """ SELECT id, round_even(min(x), 3) AS xmin, round_even(min(y), 3) AS ymin,
 round_even(max(x), 3) AS xmax, round_even(max(y), 3) AS ymax FROM w GROUP BY id"""


FURTHER = (5070, 3413, 3031, 26714)


def reproject_further(spark, sf):
    """Corners of the lake in an equal-area, two polar and an older datum's system, and back."""
    found = None
    for epsg in FURTHER:
        there = C.from_lonlat("named_struct('x', bbox.xmin, 'y', bbox.ymin)", C.crs_literal(epsg))
        moved = lake(spark, sf).select("id", F.lit(epsg).alias("epsg"), there.alias("p")).withColumn("g", C.to_lonlat("p", C.crs_literal(epsg)))
        known = F.col("epsg") != 26714  # the SQL has no shift of datum: of that system only the way back is compared
        x, y = (F.when(known, F.bround(f"p.{v}", 2)) for v in "xy")
        part = moved.select("id", "epsg", x.alias("x"), y.alias("y"), F.bround("g.x", 8).alias("lon"), F.bround("g.y", 8).alias("lat"))
        found = part if found is None else found.union(part)
    return found


# Snyder's forms with logarithms and tangents of half angles.
FURTHER_SQL = f"""WITH {ctes('fx_lake')},
p AS (SELECT id, xmin AS lon, ymin AS lat, radians(ymin) AS f, sin(radians(ymin)) AS s FROM fx_lake),
grs AS (SELECT f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257222101::DOUBLE AS f)),
wgs AS (SELECT f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257223563::DOUBLE AS f)),
par AS (SELECT e, e2, unnest([23.0, 29.5, 45.5]::DOUBLE[]) AS deg FROM grs),
qm AS (SELECT deg, (1 - e2) * (sin(radians(deg)) / (1 - e2 * sin(radians(deg)) * sin(radians(deg))) - ln((1 - e * sin(radians(deg))) / (1 + e * sin(radians(deg)))) / (2 * e)) AS q,
 cos(radians(deg)) * cos(radians(deg)) / (1 - e2 * sin(radians(deg)) * sin(radians(deg))) AS mm FROM par),
k AS (SELECT max(CASE WHEN deg = 23.0 THEN q END) AS q0, max(CASE WHEN deg = 29.5 THEN q END) AS q1, max(CASE WHEN deg = 45.5 THEN q END) AS q2,
 max(CASE WHEN deg = 29.5 THEN mm END) AS m1, max(CASE WHEN deg = 45.5 THEN mm END) AS m2 FROM qm),
cone AS (SELECT (m1 - m2) / (q2 - q1) AS n, m1 + (m1 - m2) / (q2 - q1) * q1 AS c, q0 FROM k),
aea AS (SELECT id, lon, lat, n, 6378137 * sqrt(c - n * (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e))) / n AS rho,
 6378137 * sqrt(c - n * q0) / n AS rho0, n * radians(lon + 96) AS th FROM p, grs, cone),
pole AS (SELECT e, e2, 6378137 * cos(radians(ts)) / sqrt(1 - e2 * sin(radians(ts)) * sin(radians(ts)))
  / (tan(pi() / 4 - radians(ts) / 2) / pow((1 - e * sin(radians(ts))) / (1 + e * sin(radians(ts))), e / 2)) AS r, ts
  FROM wgs, (SELECT unnest([70, 71]::DOUBLE[]) AS ts)),
st AS (SELECT id, lon, lat, ts, CASE WHEN ts = 70 THEN r * tan(pi() / 4 - f / 2) / pow((1 - e * s) / (1 + e * s), e / 2)
  ELSE r * tan(pi() / 4 + f / 2) * pow((1 - e * s) / (1 + e * s), e / 2) END AS rho FROM p, pole),
u AS (SELECT id, 5070 AS epsg, rho * sin(th) AS x, rho0 - rho * cos(th) AS y, lon, lat FROM aea
 UNION ALL SELECT id, 3413, rho * sin(radians(lon + 45)), -rho * cos(radians(lon + 45)), lon, lat FROM st WHERE ts = 70
 UNION ALL SELECT id, 3031, rho * sin(radians(lon)), rho * cos(radians(lon)), lon, lat FROM st WHERE ts = 71
 UNION ALL SELECT id, 26714, NULL, NULL, lon, lat FROM p)
SELECT id, epsg, round_even(x, 2) AS x, round_even(y, 2) AS y, round_even(lon, 8) AS lon, round_even(lat, 8) AS lat FROM u"""


def dropped_by_projection(spark, sf):
    """Rows that keep only their native copy: no code, or a code without parameters."""
    fp = P.with_web_copy(utm_boxes(spark, sf))
    return P.group_by_epsg(fp)


DROPPED_BY_PROJECTION = f"""WITH {ctes('fx_utm')} SELECT collection_id, epsg, count(*) AS native_count,
 count(*) FILTER (WHERE epsg IN (26916, 26917)) AS web_count FROM fx_utm GROUP BY collection_id, epsg"""


def epsg_from_wkt(spark, sf):
    return headers(spark, sf).select("id", X.epsg_from_wkt("wkt").alias("found"), X.epsg_from_wkt("wkt", F.lit(26916)).alias("overridden"))


EPSG_FROM_WKT = HEADERS + " SELECT id, epsg AS found, coalesce(epsg, 26916) AS overridden FROM f"


# --- extents, groups, fills -------------------------------------------------------------------


def _with_web(spark, sf):
    fp = footprints(spark, sf).withColumn("native_ring", G.ring_from_bbox("bbox"))
    return fp.withColumn("web_ring", F.when(~F.col("web_missing"), F.col("native_ring")))


def extent_by_epsg(spark, sf):
    found = P.extent(_with_web(spark, sf), ("collection_id", "epsg"), ring="web_ring")
    return unboxed(found, "extent")


EXTENT = f"""WITH {ctes('fx_footprints')} SELECT collection_id, epsg, min(CASE WHEN NOT web_missing THEN xmin END) AS xmin, min(CASE WHEN NOT web_missing THEN ymin END) AS ymin,
 max(CASE WHEN NOT web_missing THEN xmax END) AS xmax, max(CASE WHEN NOT web_missing THEN ymax END) AS ymax FROM fx_footprints GROUP BY collection_id, epsg"""


def extent_finite_points(spark, sf):
    """Points with a missing, infinite or NaN coordinate do not count, the rest of the ring does."""
    bad = F.when(F.col("id") % 5 == 0, float("inf")).when(F.col("id") % 5 == 1, float("nan"))
    fp = footprints(spark, sf)
    b = F.col("bbox")
    ring = F.array(G.point(b["xmin"], b["ymin"]), G.point(F.coalesce(bad, b["xmax"]), b["ymax"]), G.point(b["xmin"], b["ymin"]))
    rings = fp.select("collection_id", "id", ring.alias("ring"))
    whole = rings.agg(F.count_if(G.is_finite_ring("ring")).alias("finite_rings"))
    found = P.extent(rings, ("collection_id",), ring="ring").withColumn("finite_rings", whole.scalar())
    return unboxed(found, "extent")


EXTENT_FINITE = f"""WITH {ctes('fx_footprints')} SELECT collection_id, min(xmin) AS xmin, min(ymin) AS ymin,
 max(CASE WHEN id % 5 > 1 THEN xmax ELSE xmin END) AS xmax, max(CASE WHEN id % 5 > 1 THEN ymax ELSE ymin END) AS ymax,
 (SELECT count(*) FROM fx_footprints WHERE id % 5 > 1) AS finite_rings FROM fx_footprints GROUP BY collection_id"""


def group_by_epsg(spark, sf):
    return P.group_by_epsg(_with_web(spark, sf))


GROUPS = f"""WITH {ctes('fx_footprints')} SELECT collection_id, epsg, count(*) AS native_count,
 count(*) FILTER (WHERE NOT web_missing) AS web_count FROM fx_footprints GROUP BY collection_id, epsg"""


def distinct_epsgs(spark, sf):
    found = P.distinct_epsgs(utm_boxes(spark, sf), ("collection_id",))
    return found.select("collection_id", F.array_join(F.transform("epsgs", lambda e: e.cast("string")), ",").alias("epsgs"))


DISTINCT_EPSGS = f"""WITH {ctes('fx_utm')}, d AS (SELECT DISTINCT collection_id, epsg FROM fx_utm WHERE epsg IS NOT NULL)
SELECT collection_id, string_agg(epsg::VARCHAR, ',' ORDER BY epsg) AS epsgs FROM d GROUP BY collection_id"""


def fill_epsg(spark, sf):
    """Missing codes: inferred per collection, not inferable over all of them, and overridden."""
    fp = footprints(spark, sf).select("id", "collection_id", "epsg")
    inferred = P.fill_epsg(fp).select("id", F.col("epsg").alias("inferred"))
    mixed = P.fill_epsg(fp.withColumn("collection_id", F.lit("all"))).select("id", F.col("epsg").alias("mixed"))
    forced = P.fill_epsg(fp, override=6527).select("id", F.col("epsg").alias("forced"))
    return inferred.join(mixed, "id").join(forced, "id")


FILL_EPSG = f"""WITH {ctes('fx_footprints')} SELECT id, CAST(coalesce(epsg, 26916 + CAST(id % 4 AS INT) % 2) AS INT) AS inferred,
 CAST(epsg AS INT) AS mixed, CAST(coalesce(epsg, 6527) AS INT) AS forced FROM fx_footprints"""


def native_web_join(spark, sf):
    """Web copies written twice: the later one wins; rows without a copy drop out."""
    fp = footprints(spark, sf)
    web = fp.where(~F.col("web_missing")).select("key", F.lit(1).alias("seq"), F.col("bbox.xmin").alias("web_xmin"))
    again = web.where(F.col("web_xmin") % 2000 == 0).select("key", F.lit(2).alias("seq"), (F.col("web_xmin") + 1).alias("web_xmin"))
    return P.native_web_join(fp.select("id", "key"), web.union(again), order="seq").select("id", "key", "web_xmin")


NATIVE_WEB = f"""WITH {ctes('fx_footprints')} SELECT id, key, CASE WHEN xmin::BIGINT % 2000 = 0 THEN xmin + 1 ELSE xmin END AS web_xmin
FROM fx_footprints WHERE NOT web_missing"""


def dropped_web(spark, sf):
    fp = footprints(spark, sf)
    return P.dropped_web(fp, fp.where(~F.col("web_missing"))).groupBy("collection_id").agg(F.count(F.lit(1)).alias("dropped"))


DROPPED = f"WITH {ctes('fx_footprints')} SELECT collection_id, count(*) AS dropped FROM fx_footprints WHERE web_missing GROUP BY collection_id"


def scan_report(spark, sf):
    fp = _with_web(spark, sf)
    results = fp.select("key", F.when(F.col("key").endswith(".xml"), F.concat(F.lit("failed to open "), F.col("key"))).alias("error"), "web_ring")
    report = P.scan_report(results)
    return report.withColumn("first_failures", F.array_join("first_failures", "|"))


SCAN_REPORT = f"""WITH {ctes('fx_footprints')}, bad AS (SELECT key FROM fx_footprints WHERE key LIKE '%.xml' ORDER BY key LIMIT 20)
SELECT count(*) AS discovered, count(*) FILTER (WHERE key NOT LIKE '%.xml') AS scanned, count(*) FILTER (WHERE key LIKE '%.xml') AS failures,
 count(*) FILTER (WHERE key NOT LIKE '%.xml' AND web_missing) AS dropped_web,
 (SELECT string_agg('failed to open ' || key, '|' ORDER BY key) FROM bad) AS first_failures,
 count(*) FILTER (WHERE key LIKE '%.xml') = 0 AS publishable FROM fx_footprints"""


def round_bounds(spark, sf):
    b = footprints(spark, sf).select("id", C.web_bbox_to_lonlat("bbox").alias("b"))
    r = b.select("id", G.round_bbox("b", 4).alias("bbox"), G.truncate_bbox("b").alias("cut"), G.center_from_bbox("b").alias("c"), G.bounds_from_bbox("b").alias("d"))
    return unboxed(r).select(
        "id", "xmin", "ymin", "xmax", "ymax", F.col("cut.xmin").alias("cut_xmin"),
        F.round(F.col("c")[0], 8).alias("center_lat"), F.round(F.col("d")[1][0], 8).alias("max_lat"),
    )


ROUND_BOUNDS = f"""WITH {ctes('fx_footprints')}, g AS (SELECT id, degrees(xmin / {R}) AS a, degrees(xmax / {R}) AS c,
 degrees(atan(sinh(ymin / {R}))) AS b, degrees(atan(sinh(ymax / {R}))) AS d FROM fx_footprints)
SELECT id, round_even(a, 4) AS xmin, round_even(b, 4) AS ymin, round_even(c, 4) AS xmax, round_even(d, 4) AS ymax, trunc(a) AS cut_xmin,
 round((b + d) / 2, 8) AS center_lat, round(d, 8) AS max_lat FROM g"""


def collection_facts(spark, sf):
    """Everything a catalog entry takes from footprints, in one row per collection."""
    facts = scan.collection_facts(_built(spark, sf))
    return facts.select(
        "collection_id", "cog_count", "native_zoom",
        F.array_join(F.transform("native_epsgs", lambda e: e.cast("string")), ",").alias("epsgs"),
        F.array_join(F.transform("groups", lambda g: g["cog_count"].cast("string")), ",").alias("group_counts"),
        F.col("extent_native")[0].alias("native_xmin"), F.col("extent_native")[3].alias("native_ymax"),
        F.col("extent_3857")[1].alias("web_ymin"), F.col("extent_3857")[2].alias("web_xmax"),
        F.col("bbox_4326")[0].alias("lon_min"), F.col("bbox_4326")[3].alias("lat_max"),
    )


FACTS = HEADERS + f""", k AS (SELECT *, 'c' || (id % 10) AS collection_id FROM f),
z AS (SELECT collection_id, native_zoom, row_number() OVER (PARTITION BY collection_id ORDER BY native_zoom) - 1 AS i,
  count(*) OVER (PARTITION BY collection_id) AS n FROM k WHERE native_zoom IS NOT NULL),
e AS (SELECT collection_id, epsg, count(*) AS n FROM k WHERE epsg IS NOT NULL GROUP BY collection_id, epsg),
es AS (SELECT collection_id, string_agg(epsg::VARCHAR, ',' ORDER BY epsg) AS epsgs, string_agg(n::VARCHAR, ',' ORDER BY epsg) AS group_counts FROM e GROUP BY collection_id),
m AS (SELECT collection_id, count(*) AS cog_count, min(xmin) AS nx, max(ymax) AS ny, min(CASE WHEN has_web THEN xmin END) AS wx0, min(CASE WHEN has_web THEN ymin END) AS wy0,
  max(CASE WHEN has_web THEN xmax END) AS wx1, max(CASE WHEN has_web THEN ymax END) AS wy1 FROM k GROUP BY collection_id)
SELECT m.collection_id, cog_count, coalesce(CAST(round_even(z.native_zoom, 0) AS INT), 18) AS native_zoom, epsgs, group_counts,
 round_even(nx, 2) AS native_xmin, round_even(ny, 2) AS native_ymax, CAST(round_even(wy0, 0) AS BIGINT) AS web_ymin, CAST(round_even(wx1, 0) AS BIGINT) AS web_xmax,
 round_even(degrees(round_even(wx0, 0) / {R}), 4) AS lon_min, round_even(degrees(atan(sinh(round_even(wy1, 0) / {R}))), 4) AS lat_max
FROM m JOIN es USING (collection_id) LEFT JOIN z ON z.collection_id = m.collection_id AND z.i = z.n // 2"""


def catalog_entry(spark, sf):
    """The catalog row of one scanned collection, field by field as JSON."""
    fp = P.fill_epsg(_built(spark, sf).withColumn("collection_id", F.lit("all-2024")), 3857)
    settings = scan.ScanSettings("all-2024", bucket="imagery", prefix="lake/", attribution="Survey", index_path="/index")
    entry = scan.collection_entry(fp, settings, F.lit("2024-05-01 00:00:00").cast("timestamp"))
    shown = F.map_entries("fields")
    return entry.select(F.explode(shown).alias("e")).select(F.col("e.key").alias("field"), F.to_json(F.struct(F.col("e.value").alias("v"))).alias("value"))


def _box_text(*edges: str) -> str:
    return "'[' || concat_ws(',', " + ", ".join(f"CAST({e} AS VARCHAR)" for e in edges) + ") || ']'"


def _entry_sql() -> str:
    """One row a field: constants of the scan's settings, and what comes from the rows."""
    fixed = {
        "type": '"Collection"', "stac_version": '"1.0.0"', "id": '"all-2024"', "title": '"all-2024"', "license": '"various"',
        "description": '"COG collection \'\'all-2024\'\' scanned from S3"', "providers": '[{"name":"Survey","roles":["producer","host"]}]',
        "links": '[{"href":"./all-2024.json","rel":"self","type":"application/json"}]', "layer_name": '"all-2024"',
        "map_name": '"all-2024-imagery"', "label": '"all-2024"', "attribution": '"Survey"', "enabled": "true", "draw_order": "10",
        "source": '{"access_mode":"unsigned","bucket":"imagery","prefix":"lake/","region":"us-west-2","requester_pays":false}',
        "postgis": "false", "indexed_at": '"2024-05-01T00:00:00Z"',
    }
    index = "'/index/collection_id=all-2024/native_epsg=' || code"
    extent = """'{"spatial":{"bbox":[' || lonlat || ']},"temporal":{"interval":[["2024-05-01T00:00:00Z","2024-05-01T00:00:00Z"]]}}'"""
    derived = {
        "extent": extent, "layer_names": "'[' || names || ']'", "min_zoom": "zoom - 4", "max_zoom": "zoom + 1", "native_zoom": "zoom",
        "native_epsg": "code", "native_epsgs": "'[' || codes || ']'", "cog_count": "n", "bbox_4326": "lonlat", "extent_3857": "web",
        "extent_native": "native", "tileindexes": "'[' || groups || ']'", "tileindex": f"""'"' || {index} || '"'""",
        "tileindex_layer_name": """'"all-2024_tileindex_' || code || '"'""",
    }
    rows = [f"""SELECT '{k}' AS field, '{{"v":{v}}}' AS value""" for k, v in fixed.items()]
    rows += [f"""SELECT '{k}' AS field, '{{"v":' || {v} || '}}' AS value FROM a""" for k, v in derived.items()]
    whole = _box_text(*(f"CAST({f}({e}) AS BIGINT)" for f, e in (("min", "xmin"), ("min", "ymin"), ("max", "xmax"), ("max", "ymax"))))
    lonlat = _box_text(
        f"round_even(degrees(wx0 / {R}), 4)", f"round_even(degrees(atan(sinh(wy0 / {R}))), 4)",
        f"round_even(degrees(wx1 / {R}), 4)", f"round_even(degrees(atan(sinh(wy1 / {R}))), 4)",
    )
    layer = "'\"all-2024' || CASE WHEN many > 1 THEN '-' || code ELSE '' END || '\"'"
    return HEADERS + f""", k AS (SELECT *, coalesce(epsg, 3857) AS code FROM f),
e AS (SELECT code, count(*) AS n, {whole} AS box, count(*) OVER () AS many FROM k GROUP BY code),
es AS (SELECT min(code) AS code, string_agg(code::VARCHAR, ',' ORDER BY code) AS codes, string_agg({layer}, ',' ORDER BY code) AS names,
 string_agg('{{"cog_count":' || n || ',"epsg":' || code || ',"extent_native":' || box || ',"layer_name":' || {layer} || ',"tileindex":"' || {index}
  || '","tileindex_layer_name":"all-2024_tileindex_' || code || '"}}', ',' ORDER BY code) AS groups FROM e),
z AS (SELECT native_zoom, row_number() OVER (ORDER BY native_zoom) - 1 AS i, count(*) OVER () AS m FROM k WHERE native_zoom IS NOT NULL),
m AS (SELECT count(*) AS n, {whole} AS native, min(CASE WHEN has_web THEN xmin END) AS wx0, min(CASE WHEN has_web THEN ymin END) AS wy0,
 max(CASE WHEN has_web THEN xmax END) AS wx1, max(CASE WHEN has_web THEN ymax END) AS wy1 FROM k),
a AS (SELECT es.*, n, native, {_box_text(*(f'CAST({c} AS BIGINT)' for c in ('wx0', 'wy0', 'wx1', 'wy1')))} AS web, {lonlat} AS lonlat,
 (SELECT CAST(round_even(native_zoom, 0) AS INT) FROM z WHERE i = m // 2) AS zoom FROM es, m)
""" + " UNION ALL ".join(rows)


CATALOG_ENTRY = _entry_sql()


# --- listing, order, index tables -------------------------------------------------------------


def list_rasters(spark, sf):
    return readers.rasters(fixture(spark, sf, "fx_footprints").select("key"), "lake/S").select("key", X.file_name("key").alias("file_name"))


LIST_RASTERS = f"""WITH {ctes('fx_footprints')} SELECT key, regexp_extract(key, '[^/]*$') AS file_name FROM fx_footprints
WHERE key LIKE 'lake/S%' AND (lower(key) LIKE '%.tif' OR lower(key) LIKE '%.tiff')"""


def list_rasters_limit(spark, sf):
    return readers.rasters(fixture(spark, sf, "fx_footprints").select("key"), "lake/", 500)


LIST_LIMIT = f"""WITH {ctes('fx_footprints')} SELECT key FROM fx_footprints
WHERE key LIKE 'lake/%' AND (lower(key) LIKE '%.tif' OR lower(key) LIKE '%.tiff') ORDER BY key LIMIT 500"""


def z_order(spark, sf):
    return footprints(spark, sf).select("id", G.z_order("bbox", bits=8).alias("z"))


def _bits(v: str) -> str:
    return " + ".join(f"(({v} >> {i}) & 1) * {4 ** i}" for i in range(8))


Z_ORDER = f"""WITH {ctes('fx_footprints')}, c AS (SELECT id, CAST(least(greatest(floor(((xmin + xmax) / 2 + {E}) / (2 * {E}) * 256), 0), 255) AS BIGINT) AS cx,
 CAST(least(greatest(floor(((ymin + ymax) / 2 + {E}) / (2 * {E}) * 256), 0), 255) AS BIGINT) AS cy FROM fx_footprints)
SELECT id, CAST({_bits('cx')} + 2 * ({_bits('cy')}) AS BIGINT) AS z FROM c"""


def _index_rows(spark, sf):
    fp = _with_web(spark, sf).withColumn("key", F.concat_ws("#", "key", F.col("id").cast("string")))
    return fp.withColumn("native_epsg", F.col("epsg")).select("collection_id", "key", "native_epsg", "bbox")


def tile_index_table(spark, sf):
    """Written as a tile index, read back: rows without a code are in no group."""
    path = scratch_path(spark, "tile-index")
    writers.write_tile_index(_index_rows(spark, sf), path)
    back = readers.read_index(spark, path)
    return unboxed(back.select("collection_id", F.col("native_epsg").cast("int").alias("native_epsg"), "key", "bbox"))


TILE_INDEX = f"""WITH {ctes('fx_footprints')} SELECT collection_id, CAST(epsg AS INT) AS native_epsg, key || '#' || id AS key, xmin, ymin, xmax, ymax
FROM fx_footprints WHERE epsg IS NOT NULL"""


def _load_all(rows, path):
    for c in range(4):  # the collections of the footprints
        writers.replace_collection(rows, path, f"c{c}")


def replaced_collection(spark, sf):
    """Footprint table: load every collection, reload one of them with fewer rows, read all."""
    path = scratch_path(spark, "footprint-table")
    rows = _index_rows(spark, sf).withColumn("native_epsg", F.coalesce("native_epsg", F.lit(26916)))
    _load_all(rows, path)
    writers.replace_collection(rows.where(F.col("bbox.xmin") < -9480000), path, "c2")
    return spark.read.parquet(path).select("collection_id", "key", "native_epsg")


REPLACED = f"""WITH {ctes('fx_footprints')} SELECT collection_id, key || '#' || id AS key, CAST(coalesce(epsg, 26916) AS INT) AS native_epsg FROM fx_footprints
WHERE collection_id <> 'c2' OR xmin < -9480000"""


def by_collection(spark, sf):
    """Projected read of one collection from the written table of all."""
    path = scratch_path(spark, "footprint-table")
    _load_all(_index_rows(spark, sf).withColumn("native_epsg", F.lit(3857)), path)
    return readers.read_index(spark, path, "c3", ["key", "native_epsg"])


BY_COLLECTION = f"WITH {ctes('fx_footprints')} SELECT key || '#' || id AS key, 3857 AS native_epsg FROM fx_footprints WHERE collection_id = 'c3'"


def staged_window(spark, sf):
    """A window query on the spatially sorted, small-row-group form of the index."""
    path = scratch_path(spark, "staged")
    writers.write_staged_index(footprints(spark, sf).select("id", "key", "bbox"), path, tie=("id",))
    from .spatial import WINDOW

    return readers.read_window(spark, path, WINDOW).select("id", "key")


def exported_features(spark, sf):
    """Features written per code as GeoJSON lines and read again as text."""
    fp = _with_web(spark, sf).where("epsg IS NOT NULL")
    path = scratch_path(spark, "features")
    writers.export_features(fp, path, "native_ring", ["id", "key"])
    schema = "type string, properties struct<id:bigint,key:string,crs:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
    back = spark.read.schema(schema).json(path)
    ring = F.col("geometry.coordinates")[0]
    return back.select("properties.id", "properties.key", "properties.crs", F.size(ring).alias("points"), ring[2][0].alias("xmax"), ring[2][1].alias("ymax"))


EXPORTED = f"""WITH {ctes('fx_footprints')} SELECT id, key, 'urn:ogc:def:crs:EPSG::' || epsg AS crs, 5 AS points, xmax, ymax FROM fx_footprints WHERE epsg IS NOT NULL"""


def clustered(spark, sf):
    """Spatial clustering keeps every row."""
    return staging.cluster_spatially(footprints(spark, sf).select("id", "bbox"), tie=("id",)).select("id")


def last_wins(spark, sf):
    """Latest line of every order, from all line items."""
    li = derive(spark, sf, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem")
    newest = ranks.keep_first(li, ["l_orderkey"], [F.col(c).desc() for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")])
    return newest.select("l_orderkey", "l_linenumber", "l_partkey")


LAST_WINS = """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1"""

QUERIES = {
    "footprint_from_header": (footprint_from_header, FOOTPRINTS),
    "native_zoom": (native_zoom, NATIVE_ZOOM),
    "median_zoom": (median_zoom, MEDIAN_ZOOM),
    "reproject_rings": (reproject_rings, REPROJECTED + " SELECT id, i, round(x, 3) AS x, round(y, 3) AS y FROM w"),
    "reproject_boxes": (reproject_boxes, REPROJECTED_BOXES),
    "reproject_further": (reproject_further, FURTHER_SQL),
    "dropped_by_projection": (dropped_by_projection, DROPPED_BY_PROJECTION),
    "epsg_from_wkt": (epsg_from_wkt, EPSG_FROM_WKT),
    "extent_by_epsg": (extent_by_epsg, EXTENT),
    "extent_finite_points": (extent_finite_points, EXTENT_FINITE),
    "group_by_epsg": (group_by_epsg, GROUPS),
    "distinct_epsgs": (distinct_epsgs, DISTINCT_EPSGS),
    "fill_epsg": (fill_epsg, FILL_EPSG),
    "native_web_join": (native_web_join, NATIVE_WEB),
    "dropped_web": (dropped_web, DROPPED),
    "scan_report": (scan_report, SCAN_REPORT),
    "round_bounds": (round_bounds, ROUND_BOUNDS),
    "collection_facts": (collection_facts, FACTS),
    "catalog_entry": (catalog_entry, CATALOG_ENTRY),
    "list_rasters": (list_rasters, LIST_RASTERS),
    "list_rasters_limit": (list_rasters_limit, LIST_LIMIT),
    "z_order": (z_order, Z_ORDER),
    "tile_index_table": (tile_index_table, TILE_INDEX),
    "replaced_collection": (replaced_collection, REPLACED),
    "by_collection": (by_collection, BY_COLLECTION),
    "staged_window": (staged_window, f"WITH {ctes('fx_footprints')} SELECT id, key FROM fx_footprints WHERE xmin <= -9480000 AND xmax >= -9495000 AND ymin <= 4520000 AND ymax >= 4505000"),
    "exported_features": (exported_features, EXPORTED),
    "cluster_spatially": (clustered, f"WITH {ctes('fx_footprints')} SELECT id FROM fx_footprints"),
    "last_wins": (last_wins, LAST_WINS),
}
