"""Representative inputs derived from the given tables.

Each view is one SELECT that means the same in Spark and in DuckDB, so the Spark queries and the
checking SQL start from identical rows. ``{table}`` names are the only inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, str] = {
    "fx_footprints": """
SELECT p_partkey AS id,
       concat('c', CAST(p_partkey % 4 AS STRING)) AS collection_id,
       concat('lake/', p_type, '/', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 10 = 0 THEN '.TIFF' WHEN p_partkey % 10 = 1 THEN '.xml' ELSE '.tif' END) AS key,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 26916 + CAST(p_partkey % 4 AS INT) % 2 END AS epsg,
       CAST(-9500000 + (p_partkey % 50) * 1000 AS DOUBLE) AS xmin,
       CAST(4500000 + CAST(floor(p_partkey / 50.0) AS BIGINT) * 1000 AS DOUBLE) AS ymin,
       CAST(-9500000 + (p_partkey % 50) * 1000 + 1000 - (p_partkey % 7) * 10 AS DOUBLE) AS xmax,
       CAST(4500000 + CAST(floor(p_partkey / 50.0) AS BIGINT) * 1000 + 1000 + (p_partkey % 5) * 20 AS DOUBLE) AS ymax,
       CAST(p_partkey % 13 = 0 AS BOOLEAN) AS web_missing
FROM part""",
    "fx_headers": """
SELECT p_partkey AS id, concat('lake/', CAST(p_partkey AS STRING), '.tif') AS key,
       CAST(-9500000 + (p_partkey % 50) * 1000 AS DOUBLE) AS gt0, CAST(0.5 + p_size AS DOUBLE) AS gt1, CAST(0 AS DOUBLE) AS gt2,
       CAST(4501000 + CAST(floor(p_partkey / 50.0) AS BIGINT) * 1000 AS DOUBLE) AS gt3, CAST(0 AS DOUBLE) AS gt4, CAST(-0.5 - p_size AS DOUBLE) AS gt5,
       2000 AS width, 2000 AS height, 3 AS bands, 'Byte' AS data_type
FROM part""",
    "fx_access_log": """
SELECT event_id, ts, event_type AS method,
       CASE WHEN event_type IN ('view', 'click') THEN concat('REQUEST=GetMap&user=', CAST(user_id AS STRING)) ELSE 'REQUEST=GetCapabilities' END AS args,
       CASE WHEN event_type = 'error' THEN 502 ELSE 200 END AS status,
       CAST(event_id % 5000 AS BIGINT) AS size,
       CASE WHEN event_id % 97 = 0 THEN '-' ELSE concat(CAST(CAST(floor(value) AS INT) % 5 AS STRING), '.', lpad(CAST(CAST(floor(value * 7) AS INT) % 100 AS STRING), 2, '0')) END AS upstream_time_s,
       CASE WHEN user_id % 3 = 0 THEN 'HIT' WHEN user_id % 3 = 1 THEN 'MISS' ELSE 'EXPIRED' END AS cache_status
FROM events""",
    "fx_scan_log": """
SELECT user_id AS job_id, event_id AS line_no,
       concat('Scanned ', CAST(event_id % 1000 AS STRING), '/1000; failures=', CAST(event_id % 7 AS STRING)) AS line
FROM events""",
    "fx_catalog": """
SELECT p_brand AS id, count(*) AS cog_count, CAST(min(p_size) AS INT) AS draw_order,
       CASE WHEN min(p_partkey) % 3 = 0 THEN false WHEN min(p_partkey) % 3 = 1 THEN true ELSE NULL END AS enabled
FROM part GROUP BY p_brand""",
    "fx_selections": """
SELECT lower(substr(n_name, 1, 2)) AS state, 2018 + n_regionkey AS year, n_nationkey AS pos FROM nation""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run ``sql`` over the given tables; every table named in it is bound as a DataFrame argument."""
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    frames = {name: table(spark, sf_dir, name) for name in TABLES if name in words}
    text = sql
    for name in frames:
        for lead in ("FROM", "JOIN"):
            text = text.replace(f"{lead} {name}", f"{lead} {{{name}}}")
    return spark.sql(text, **frames)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(spark, sf_dir, FIXTURES[name])
