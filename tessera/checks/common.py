"""Shared inputs of the registered queries, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import FIXTURES, derive, fixture
from ..functions import geometry as G

E = "20037508.342789244::DOUBLE"
R = "6378137::DOUBLE"

# A footprint lake over three regions and eight years, in lon/lat.
LAKE_SQL = """
SELECT c_custkey AS id,
       CASE WHEN c_nationkey % 3 = 0 THEN 'na' WHEN c_nationkey % 3 = 1 THEN 'tx' ELSE 'ct' END AS region,
       CAST(2018 + c_custkey % 8 AS INT) AS year,
       concat('bucket-', CAST(c_nationkey % 2 AS STRING)) AS source_bucket,
       concat('naip/', CAST(c_custkey AS STRING), '.tif') AS source_key,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(26910 + c_custkey % 5 AS INT) END AS proj_epsg,
       CAST(-100 AS DOUBLE) + (c_custkey % 100) * CAST(0.0625 AS DOUBLE) AS xmin,
       CAST(30 AS DOUBLE) + (c_custkey % 61) * CAST(0.0625 AS DOUBLE) AS ymin,
       CAST(-100 AS DOUBLE) + (c_custkey % 100) * CAST(0.0625 AS DOUBLE) + CAST(0.075 AS DOUBLE) AS xmax,
       CAST(30 AS DOUBLE) + (c_custkey % 61) * CAST(0.0625 AS DOUBLE) + CAST(0.0625 AS DOUBLE) AS ymax
FROM customer"""

# Native boxes in UTM zone 16 or 17 (or an unknown system), for everything that reprojects.
UTM_SQL = """
SELECT p_partkey AS id, concat('c', CAST(p_partkey % 4 AS STRING)) AS collection_id,
       concat('utm/', CAST(p_partkey AS STRING), '.tif') AS key,
       CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN 99999 ELSE 26916 + CAST(p_partkey % 2 AS INT) END AS epsg,
       2000 AS width,
       CAST(300000 + (p_partkey % 50) * 1000 AS DOUBLE) AS xmin,
       CAST(4300000 + CAST(floor(p_partkey / 50.0) AS BIGINT) * 1000 AS DOUBLE) AS ymin,
       CAST(300000 + (p_partkey % 50) * 1000 + 1000 + p_size AS DOUBLE) AS xmax,
       CAST(4300000 + CAST(floor(p_partkey / 50.0) AS BIGINT) * 1000 + 1000 + p_size AS DOUBLE) AS ymax
FROM part"""

INPUTS = {**FIXTURES, "fx_lake": LAKE_SQL, "fx_utm": UTM_SQL}


def ctes(*names: str) -> str:
    return ",\n".join(f"{n} AS ({INPUTS[n]})" for n in names)


def boxed(df: DataFrame) -> DataFrame:
    """The four edge columns as one ``bbox`` struct."""
    return df.withColumn("bbox", G.bbox("xmin", "ymin", "xmax", "ymax")).drop("xmin", "ymin", "xmax", "ymax")


def unboxed(df: DataFrame, box: str = "bbox", prefix: str = "") -> DataFrame:
    edges = [F.col(f"{box}.{f}").alias(prefix + f) for f in G.BBOX_FIELDS]
    return df.select(*[c for c in df.columns if c != box], *edges)


def footprints(spark: SparkSession, sf: str) -> DataFrame:
    return boxed(fixture(spark, sf, "fx_footprints"))


def lake(spark: SparkSession, sf: str) -> DataFrame:
    return boxed(derive(spark, sf, LAKE_SQL))


def utm_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return boxed(derive(spark, sf, UTM_SQL)).withColumnRenamed("bbox", "native_bbox")


def access_log(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_access_log")


def scan_log(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_scan_log")
