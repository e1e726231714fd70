"""Readers of listings, headers, lakes, selections, catalogs, features, indexes and logs."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import ranks, spatial, staging
from ..operators.catalog import CATALOG_SCHEMA
from . import files

HEADER_SCHEMA = (
    "bucket string, key string, wkt string, gt array<double>, width int, height int, bands int, data_type string"
)
ACCESS_LOG_SCHEMA = (
    "timestamp timestamp, remote_addr string, method string, uri string, args string, status int, size bigint, "
    "upstream_time_s string, total_time_s double"
)
CACHE_LOG_SCHEMA = (
    "timestamp timestamp, remote_addr string, method string, uri string, status int, size bigint, range string, "
    "cache_status string, upstream_time_s string, total_time_s double"
)
FEATURE_PROPERTIES = (
    "collection string, location string, bucket string, key string, file_name string, epsg int, width int, "
    "height int, bands int, data_type string"
)
FEATURE_COLLECTION = (
    f"name string, features array<struct<properties:struct<{FEATURE_PROPERTIES.replace(' ', ':').replace(',:', ',')}>,"
    "geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
)


# --- listings ---------------------------------------------------------------------------------


def rasters(listing: DataFrame, prefix: str = "", limit: int = 0, key: str = "key") -> DataFrame:
    """Raster keys under a prefix, suffix in any case; with ``limit`` the first ones in key order."""
    found = listing.where(F.col(key).startswith(prefix) & X.is_raster_key(key))
    return found.orderBy(key).limit(limit) if limit else found


def list_rasters(spark: SparkSession, root: str, prefix: str = "", limit: int = 0) -> DataFrame:
    """Raster files under ``root/prefix``: ``key, length, modified``. File contents are never read."""
    base = files.qualified(spark, root).rstrip("/")
    files_found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{base}/{prefix.rpartition('/')[0]}".rstrip("/"))
    # keys are what follows the root at the beginning of the path, so that a root's name may come again below it
    listed = files_found.select(
        F.substring(files.bare(F.col("path")), F.lit(len(files.bare_text(base)) + 2), F.length("path")).alias("key"),
        "length",
        F.col("modificationTime").alias("modified"),
    )
    return rasters(listed, prefix, limit)


def storage_listing(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of every file under ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


# --- headers, lake, selections ----------------------------------------------------------------


def read_headers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(HEADER_SCHEMA).format(fmt).load(path)


def read_lake(spark: SparkSession, root: str) -> DataFrame:
    """Footprint lake laid out as ``collection=/region=/year=``; the folders become columns."""
    return spark.read.option("basePath", root).parquet(root)


def read_selected(spark: SparkSession, root: str, selections: DataFrame) -> DataFrame:
    """Rows of the selected partitions of a lake; a selection with its own address is read from there.

    The selections are a validated configuration. They become part of the plan: a predicate over the partition columns, so
    that other folders are never opened, and one scan over all explicit addresses, whose files say which selection their
    rows belong to.
    """
    chosen = [(r["state"], int(r["year"]), r["uri"] or "") for r in selections.select("state", "year", "uri").distinct().collect()]
    lake = read_lake(spark, root).where(partition_predicate([(s, y) for s, y, uri in chosen if not uri]))
    addressed = [x for x in chosen if x[2]]
    return lake.unionByName(read_addresses(spark, addressed), allowMissingColumns=True) if addressed else lake


def partition_predicate(selected: list[tuple[str, int]]) -> Column:
    """Condition on the lake's folders: of each year the regions wanted."""
    by_year: dict[int, list[str]] = {}
    for region, year in sorted(set(selected)):
        by_year.setdefault(year, []).append(region)
    found = F.lit(False)
    for year, regions in by_year.items():
        found = found | ((F.col("year") == year) & F.col("region").isin(regions))
    return found


def read_addresses(spark: SparkSession, selected: list[tuple[str, int, str]]) -> DataFrame:
    """Rows of explicit addresses (files or folders) with their selections' ``region`` and ``year``, by one scan.

    An address that several selections name gives its rows to each of them.
    """
    places = {uri: files.bare_text(files.qualified(spark, uri)).rstrip("/") for _, _, uri in selected}
    tops = {u: p for u, p in places.items() if not any(p != q and p.startswith(q + "/") for q in places.values())}
    one_each = list({p: u for u, p in tops.items()}.values())
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(*one_each)
    owners = []
    for name in rows.inputFiles():  # as many names as the scan lists itself
        plain = files.unescaped(files.bare_text(name))
        owners += [(plain, s, y) for s, y, uri in selected if plain == places[uri] or plain.startswith(places[uri] + "/")]
    owner = spark.createDataFrame(owners, "__file string, region string, year int")
    plain_rows = rows.select("*", files.decoded(F.col("_metadata.file_path")).alias("__file")).drop("region", "year")
    return plain_rows.join(owner, "__file").drop("__file")


def parse_selections(df: DataFrame, column: str = "raw") -> DataFrame:
    """Selection documents, ``{state: year}`` or a list of objects, as ``state, year, uri, label`` text rows."""
    v = F.try_parse_json(F.col(column))
    kind = F.substring(F.ltrim(F.col(column)), 1, 1)
    pairs = df.where(kind == "{").select(
        F.explode(F.from_json(F.col(column), "map<string,string>")).alias("state", "year")
    ).select("state", "year", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("label"))
    listed = df.where(kind == "[").select(
        F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("e")
    )

    def text(name: str) -> Column:
        return F.try_variant_get("e", f"$.{name}", "string").alias(name)

    return pairs.union(listed.select(text("state"), text("year"), text("uri"), text("label")))


def read_selections(spark: SparkSession, document: str) -> DataFrame:
    """Validated selections of one JSON document."""
    raw = parse_selections(spark.createDataFrame([(document or "",)], "raw string"))
    return staging.validate_selections(raw)


# --- catalog, features, index -----------------------------------------------------------------


def parse_catalog(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Catalog rows of JSON documents; text that is not a catalog gives no rows."""
    items = F.try_variant_get(F.try_parse_json(F.col(column)), "$.collections", "array<variant>")
    each = docs.select(F.posexplode(items).alias("position", "item"))
    fields = F.from_json(F.to_json("item"), "map<string,variant>")
    return each.select(
        F.col("position").cast("bigint").alias("position"),
        F.try_variant_get("item", "$.id", "string").alias("id"),
        fields.alias("fields"),
    )


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG_SCHEMA)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog document at ``path``; missing or unreadable means empty."""
    if not files.exists(spark, path):
        return empty_catalog(spark)
    return parse_catalog(spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc"))


def catalog_header(spark: SparkSession, path: str) -> dict | None:
    """Every key of the document but its collections, or None where there is none; text that is no catalog is an error."""
    if not files.exists(spark, path):
        return None
    doc = spark.read.text(path, wholetext=True)
    fields = F.from_json("value", "map<string,variant>")
    small = F.map_filter(fields, lambda k, _v: k != "collections")
    listed = F.try_variant_get(F.try_parse_json("value"), "$.collections", "array<variant>").isNotNull()
    row = doc.select(listed.alias("ok"), F.to_json(small).alias("header")).first()
    if row is None or not row["ok"]:
        raise ValueError(f"{path} exists but is not a catalog document")
    return json.loads(row["header"])


def catalog_version(spark: SparkSession, path: str) -> int | None:
    """``version`` of the document, from its small header."""
    if not files.exists(spark, path):
        return None
    doc = spark.read.text(path, wholetext=True)
    row = doc.select(F.try_variant_get(F.try_parse_json("value"), "$.version", "int").alias("v")).first()
    return row["v"] if row else None


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections with their layer name (the document's name, else the file's)."""
    docs = spark.read.option("multiLine", True).schema(FEATURE_COLLECTION).json(path)
    named = docs.select(
        F.coalesce(F.nullif("name", F.lit("")), X.file_stem(F.col("_metadata.file_name"))).alias("layer"),
        F.explode("features").alias("f"),
    )
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: G.point(p[0], p[1]))
    return named.select("layer", "f.properties.*", ring.alias("ring"))


#: Beside rows that arrive in loads: which loads there are.
LEDGER = "_ledger"


def current_loads(spark: SparkSession, path: str) -> DataFrame:
    """(collection_id, load): the load of each collection that counts."""
    if not files.children(spark, f"{path}/{LEDGER}"):
        return spark.createDataFrame([], "collection_id string, load bigint")
    ledger = spark.read.schema("collection_id string, load bigint, batch string").parquet(f"{path}/{LEDGER}")
    return ledger.groupBy("collection_id").agg(F.max("load").alias("load"))


def read_index(spark: SparkSession, path: str, collection_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Index rows of one collection: the partition filter and the column list both reach the scan.

    Of a table that arrives in loads, the rows of the current load of each collection, one for each location. Folders of
    other loads are not read.
    """
    df = files.read_with_text_ids(spark, path)
    if collection_id is not None:
        df = by_collection(df, collection_id)
    if files.exists(spark, f"{path}/{LEDGER}"):
        rows = df.withColumn("load", F.col("load").cast("bigint")).join(current_loads(spark, path), ["collection_id", "load"], "left_semi")
        df = ranks.keep_first(rows, ["collection_id", "location"], [F.col("seq").desc(), F.col("batch").desc()]).drop("batch")
    return df.select(*columns) if columns else df


def read_window(spark: SparkSession, path: str, window: tuple[float, float, float, float], box: str = "bbox") -> DataFrame:
    """Rows of a staged index that intersect the window; only files whose box meets it are opened.

    The table of file boxes has one row for each file, and the names chosen from it are no more than the scan would list.
    An index without that table is read as a whole, its row groups pruned by their statistics.
    """
    if not files.exists(spark, f"{path}/{files.FILE_BOXES}"):
        return spatial.bbox_window(spark.read.parquet(path), window, box)
    edges = ("file string", *(f"{e} double" for e in G.BBOX_FIELDS), "n bigint")
    boxes = spark.read.schema(", ".join(edges)).parquet(f"{path}/{files.FILE_BOXES}")
    met = spatial.bbox_window(boxes.select("file", G.bbox(*G.BBOX_FIELDS).alias("b")), window, "b")
    names = [f"{path.rstrip('/')}/{files.escaped(r['file'])}" for r in met.select("file").toLocalIterator()]
    whole = spark.read.parquet(path)
    if not names:
        return whole.where(F.lit(False))
    chosen = spark.read.schema(whole.schema).option("basePath", path).parquet(*names)
    return spatial.bbox_window(chosen, window, box)


def by_collection(index: DataFrame, collection_id: str) -> DataFrame:
    return index.where(F.col("collection_id") == collection_id)


def read_index_jdbc(
    spark: SparkSession, url: str, table: str = "cog_index", collection_id: str | None = None,
    partitions: int = 1, bounds: tuple[int, int] | None = None, **options: str,
) -> DataFrame:
    """Existing relational index. With ``bounds`` of the numeric ``id`` it is read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if bounds:
        reader = (
            reader.option("partitionColumn", "id").option("lowerBound", bounds[0])
            .option("upperBound", bounds[1]).option("numPartitions", partitions)
        )
    df = reader.load()
    return by_collection(df, collection_id) if collection_id is not None else df


# --- logs -------------------------------------------------------------------------------------


def read_access_log(spark: SparkSession, path: str, cache: bool = False) -> DataFrame:
    return spark.read.schema(CACHE_LOG_SCHEMA if cache else ACCESS_LOG_SCHEMA).json(path)


def stream_access_log(spark: SparkSession, path: str, cache: bool = False, **options: str) -> DataFrame:
    schema = CACHE_LOG_SCHEMA if cache else ACCESS_LOG_SCHEMA
    return spark.readStream.schema(schema).options(**options).json(path)


def _scan_lines(lines: DataFrame) -> DataFrame:
    """One job per file, or per ``job_id=`` folder; lines written as ``<number><tab><text>``."""
    job = F.col("job_id").cast("string") if "job_id" in lines.columns else X.file_stem(F.col("_metadata.file_name"))
    return lines.select(
        job.alias("job_id"),
        F.split("value", "\t", 2)[0].try_cast("bigint").alias("line_no"),
        F.split("value", "\t", 2)[1].alias("line"),
    )


def read_scan_log(spark: SparkSession, path: str) -> DataFrame:
    return _scan_lines(spark.read.text(path))


def stream_scan_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return _scan_lines(spark.readStream.options(**options).text(path))


def try_read(reader, *args):
    """``reader(*args)`` or None when the path does not exist."""
    try:
        return reader(*args)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
