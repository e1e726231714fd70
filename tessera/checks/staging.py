"""Lake selection, staging, per-selection summaries and generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture
from ..functions import crs as C
from ..functions import text as X
from ..operators import catalog as K
from ..operators import staging
from ..plans import refresh
from ..session import scratch_path
from ..sinks import generations, writers
from ..sources import readers
from .common import R, ctes, lake, unboxed

TEMPLATE = "s3://footprints/lake/collection=naip/region={state}/year={year}/data_0.parquet"


def _selections(spark, sf):
    return fixture(spark, sf, "fx_selections").select("state", F.col("year").cast("string").alias("year")).distinct().withColumns(
        {"uri": F.when(F.col("year") == "2019", F.lit("s3://other/2019.parquet")), "label": F.lit(None).cast("string")}
    )


def selection_semi(spark, sf):
    return staging.selected_partitions(lake(spark, sf), _selections(spark, sf)).select("id", "region", "year")


SELECTED = f"""WITH {ctes('fx_lake', 'fx_selections')} SELECT id, region, year FROM fx_lake l
WHERE EXISTS (SELECT 1 FROM fx_selections s WHERE s.state = l.region AND s.year = l.year)"""


def lake_partitions(spark, sf):
    """The lake written in its folder layout, read back with only the selected folders; those of 2019 have an address of their own."""
    path = scratch_path(spark, "lake")
    rows = lake(spark, sf).withColumn("collection", F.lit("naip")).repartitionByRange("region", "year", "id")
    rows.where("year <> 2019").write.partitionBy("collection", "region", "year").parquet(f"{path}/lake")
    rows.where("year = 2019").drop("year").write.partitionBy("region").parquet(f"{path}/apart")
    own = F.when(F.col("year") == "2019", F.concat(F.lit(f"{path}/apart/region="), "state"))
    chosen = _selections(spark, sf).withColumn("uri", own)
    return readers.read_selected(spark, f"{path}/lake", chosen).select("collection", "region", "year", "id")


LAKE_PARTITIONS = f"""WITH {ctes('fx_lake', 'fx_selections')} SELECT 'naip' AS collection, region, year, id FROM fx_lake l
WHERE EXISTS (SELECT 1 FROM fx_selections s WHERE s.state = l.region AND s.year = l.year)"""


def staged_columns(spark, sf):
    rows = staging.staged_columns(lake(spark, sf), "http://localhost:8001/")
    return rows.select("id", "location", "tile_srs")


STAGED = f"""WITH {ctes('fx_lake')} SELECT id, 'http://localhost:8001/requester-pays/us-west-2/' || source_bucket || '/' || source_key AS location,
 'EPSG:' || proj_epsg::VARCHAR AS tile_srs FROM fx_lake"""


def index_summary(spark, sf):
    s = staging.index_summary(staging.selected_partitions(lake(spark, sf), _selections(spark, sf)))
    flat = unboxed(unboxed(s, "bbox_4326"), "extent_3857", "web_")
    ints = {f"web_{f}": F.col(f"web_{f}").cast("bigint") for f in ("xmin", "ymin", "xmax", "ymax")}
    return flat.withColumn("native_epsgs", F.array_join(F.transform("native_epsgs", lambda e: e.cast("string")), ",")).withColumns(ints)


SUMMARY = f"""WITH {ctes('fx_lake', 'fx_selections')}, l AS (SELECT * FROM fx_lake l WHERE EXISTS (SELECT 1 FROM fx_selections s WHERE s.state = l.region AND s.year = l.year)),
m AS (SELECT region, year, count(*) AS cog_count, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM l GROUP BY region, year),
e AS (SELECT region, year, string_agg(e::VARCHAR, ',' ORDER BY e) AS native_epsgs FROM (SELECT DISTINCT region, year, proj_epsg AS e FROM l WHERE proj_epsg IS NOT NULL) GROUP BY region, year)
SELECT m.*, native_epsgs, CAST(trunc(radians(xmin) * {R}) AS BIGINT) AS web_xmin, CAST(trunc({R} * asinh(tan(radians(ymin)))) AS BIGINT) AS web_ymin,
 CAST(trunc(radians(xmax) * {R}) AS BIGINT) AS web_xmax, CAST(trunc({R} * asinh(tan(radians(ymax)))) AS BIGINT) AS web_ymax FROM m JOIN e USING (region, year)"""


def judged_selections(spark, sf):
    """Every nation as a selection, with broken states and years mixed in."""
    raw = fixture(spark, sf, "fx_selections").select(
        F.when(F.col("pos") % 5 == 1, F.concat(F.lit(" T"), F.col("state"))).when(F.col("pos") % 5 == 2, F.lit(" TX ")).otherwise(F.col("state")).alias("state"),
        F.when(F.col("pos") % 7 == 3, F.lit("soon")).when(F.col("pos") % 7 == 4, F.lit("1776")).otherwise((F.col("year") + F.col("pos") * 2).cast("string")).alias("year"),
        F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("label"),
    )
    # Two copies of one of them make a duplicate.
    again = raw.where("year = '2018'")
    return staging.judged_selections(raw.union(again)).select("state", F.col("year").cast("int").alias("year"), "problem")


JUDGED = f"""WITH {ctes('fx_selections')}, raw AS (SELECT CASE WHEN pos % 5 = 1 THEN ' T' || state WHEN pos % 5 = 2 THEN ' TX ' ELSE state END AS state,
 CASE WHEN pos % 7 = 3 THEN 'soon' WHEN pos % 7 = 4 THEN '1776' ELSE CAST(year + pos * 2 AS VARCHAR) END AS year FROM fx_selections),
al AS (SELECT lower(trim(state)) AS state, year AS given, try_cast(year AS INT) AS year FROM (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE year = '2018')),
n AS (SELECT *, count(*) OVER (PARTITION BY state, year) AS c FROM al)
SELECT state, year, CASE WHEN NOT regexp_full_match(state, '[a-z][a-z]') THEN 'invalid state code: ' || state
 WHEN year IS NULL THEN 'invalid year for ' || state || ': ' || given WHEN year NOT BETWEEN 1900 AND 2100 THEN 'year out of range for ' || state || ': ' || year
 WHEN c > 1 THEN 'duplicate parquet selection: ' || state || ':' || year END AS problem FROM n"""


def selection_documents(spark, sf):
    """Selection documents of both shapes, one per nation, taken apart."""
    one = fixture(spark, sf, "fx_selections")
    as_map = one.select(F.to_json(F.map_from_arrays(F.array("state"), F.array("year"))).alias("raw"))
    as_list = one.select(F.to_json(F.array(F.struct("state", F.col("year").cast("string").alias("year"), F.concat(F.lit("s3://b/"), F.col("pos").cast("string")).alias("uri")))).alias("raw"))
    return readers.parse_selections(as_map.union(as_list)).select("state", "year", "uri")


DOCUMENTS = f"""WITH {ctes('fx_selections')} SELECT state, CAST(year AS VARCHAR) AS year, NULL::VARCHAR AS uri FROM fx_selections
UNION ALL SELECT state, CAST(year AS VARCHAR), 's3://b/' || pos FROM fx_selections"""


def resolved_uris(spark, sf):
    resolved = staging.ordered_selections(staging.resolve_uris(_selections(spark, sf), TEMPLATE))
    parts = X.try_split_s3_uri("resolved_uri")
    return resolved.select("state", "year", "resolved_uri", parts["bucket"].alias("bucket"), parts["key"].alias("key"))


RESOLVED = f"""WITH {ctes('fx_selections')}, s AS (SELECT DISTINCT state, CAST(year AS VARCHAR) AS year FROM fx_selections),
u AS (SELECT state, year, CASE WHEN year = '2019' THEN 's3://other/2019.parquet' ELSE 's3://footprints/lake/collection=naip/region=' || state || '/year=' || year || '/data_0.parquet' END AS resolved_uri FROM s)
SELECT *, split_part(substr(resolved_uri, 6), '/', 1) AS bucket, substr(resolved_uri, 7 + length(split_part(substr(resolved_uri, 6), '/', 1))) AS key FROM u"""


def published_generation(spark, sf):
    """Two generations published one after the other; readers see the second only."""
    root = scratch_path(spark, "generations")
    rows = staging.staged_columns(lake(spark, sf), "http://localhost:8001")
    generations.publish_generation(rows.where("year = 2018"), root)  # replaced by all rows

    def write(df, path):
        writers.write_staged_index(df, path, partition_by=("region", "year"), world=180.0, tie=("source_key",))

    generations.publish_generation(rows, root, write, expected_rows=rows.count())
    back = generations.read_generation(spark, root)
    return back.select("id", "region", F.col("year").cast("int").alias("year"), "location", "tile_srs")


PUBLISHED = f"""WITH {ctes('fx_lake')} SELECT id, region, year, 'http://localhost:8001/requester-pays/us-west-2/' || source_bucket || '/' || source_key AS location,
 'EPSG:' || proj_epsg::VARCHAR AS tile_srs FROM fx_lake"""


def stale_generations(spark, sf):
    """Years of the lake that no selection points to any more, as generations."""
    known = lake(spark, sf).select(F.concat_ws("-", "region", F.col("year").cast("string")).alias("generation")).distinct()
    current = _selections(spark, sf).select(F.concat_ws("-", "state", "year").alias("generation"))
    return generations.stale_generations(known, current)


STALE = f"""WITH {ctes('fx_lake', 'fx_selections')} SELECT DISTINCT region || '-' || year AS generation FROM fx_lake
EXCEPT SELECT state || '-' || year FROM fx_selections"""


def staged_entries(spark, sf):
    """Catalog entries of staged selections, as typed columns."""
    chosen = staging.resolve_uris(_selections(spark, sf), TEMPLATE)
    summary = staging.index_summary(staging.selected_partitions(lake(spark, sf), chosen))
    rows = refresh.staged_entries(summary, chosen, "/index", "requester-pays", "us-west-2")
    t = K.collection_groups(K.typed(rows))
    return t.select("id", "epsg", "tileindex", "layer_name", "tileitem", "tilesrs", "mixed_srs", F.array_join("processing", ";").alias("processing"))


ENTRIES = f"""WITH {ctes('fx_lake', 'fx_selections')}, s AS (SELECT DISTINCT region, year FROM fx_lake l WHERE EXISTS (SELECT 1 FROM fx_selections x WHERE x.state = l.region AND x.year = l.year))
SELECT 'naip-' || region || '-' || year AS id, 4326 AS epsg, '/index/region=' || region || '/year=' || year AS tileindex, 'naip-' || region || '-' || year AS layer_name,
 'location' AS tileitem, 'tile_srs' AS tilesrs, true AS mixed_srs, 'BANDS=1,2,3;RESAMPLE=AVERAGE' AS processing FROM s"""


def per_row_crs(spark, sf):
    """Every row joined with the parameters of its own CRS."""
    rows = lake(spark, sf).select("id", F.col("proj_epsg").alias("epsg"))
    return C.with_crs(rows).select("id", F.col("crs.method").alias("method"), F.round(F.degrees("crs.lon0"), 6).alias("central_meridian"))


PER_ROW_CRS = f"""WITH {ctes('fx_lake')} SELECT id, CASE WHEN proj_epsg IS NOT NULL THEN 'tm' END AS method,
 CAST((proj_epsg - 26900) * 6 - 183 AS DOUBLE) AS central_meridian FROM fx_lake"""

QUERIES = {
    "selection_semi": (selection_semi, SELECTED),
    "lake_partitions": (lake_partitions, LAKE_PARTITIONS),
    "staged_columns": (staged_columns, STAGED),
    "index_summary": (index_summary, SUMMARY),
    "judged_selections": (judged_selections, JUDGED),
    "selection_documents": (selection_documents, DOCUMENTS),
    "resolved_uris": (resolved_uris, RESOLVED),
    "published_generation": (published_generation, PUBLISHED),
    "stale_generations": (stale_generations, STALE),
    "staged_entries": (staged_entries, ENTRIES),
    "crs_params_join": (per_row_crs, PER_ROW_CRS),
}
