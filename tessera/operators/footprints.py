"""From raster headers to footprints, and the per-collection facts derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geometry as G
from ..functions import text as X
from ..functions import tiles as T
from . import ranks


def build_footprints(
    headers: DataFrame,
    collection: str | Column,
    region: str = "us-west-2",
    proxy_base: str = "http://localhost:8001",
    requester_pays: bool = False,
    source_epsg: int = 0,
    fill_gaps: bool = False,
) -> DataFrame:
    """One footprint per header: native and web rings and boxes, location, EPSG and native zoom.

    ``headers`` has ``bucket, key, wkt, gt, width, height, bands, data_type``. No join shuffles: the CRS
    parameters come from a broadcast table of fewer than 200 rows. A header in an unknown system, or one
    whose web ring is not finite, keeps its native footprint and gets a null web copy.
    With ``fill_gaps`` a header without a code first takes the only code of its collection, see ``fill_epsg``.
    """
    name = F.lit(collection) if isinstance(collection, str) else collection
    base = headers.select(
        name.alias("collection_id"),
        "bucket",
        "key",
        X.file_name("key").alias("file_name"),
        X.location_url(
            F.lit(proxy_base), X.payer_mode(F.lit(requester_pays)), F.lit(region), F.col("bucket"), F.col("key")
        ).alias("location"),
        X.epsg_from_wkt("wkt", F.lit(source_epsg)).alias("epsg"),
        "width",
        "height",
        "bands",
        F.when(F.col("bands") > 0, F.col("data_type")).otherwise(F.lit("unknown")).alias("data_type"),
        G.footprint_bbox("gt", "width", "height").alias("native_bbox"),
    )
    return with_web_copy(fill_epsg(base, source_epsg) if fill_gaps else base)


def with_web_copy(footprints: DataFrame) -> DataFrame:
    """Add native and web rings, the web box and the native zoom to rows with ``native_bbox`` and ``epsg``.

    A row is a few bytes but costs about 0.1 ms to reproject, so rows are first dealt to a stated number of tasks: a split of the
    input by bytes would leave the work to one or two.
    """
    n = max(int(footprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ringed = C.with_crs(footprints.repartition(n).withColumn("native_ring", G.ring_from_bbox("native_bbox")))
    # ``inline`` evaluates the transform once per row; as a plain projection it would be repeated in every
    # filter and field access further up.
    moved = ringed.select("*", F.inline(F.array(F.struct(C.web_ring("native_ring", "crs").alias("__web"))))).drop("crs")
    checked = F.struct(G.keep_finite_ring("__web").alias("web_ring"), G.ring_bbox("__web").alias("__box"))
    return (
        moved.select("*", F.inline(F.array(checked)))
        .withColumn("web_bbox", F.when(F.col("web_ring").isNotNull(), F.col("__box")))
        .withColumn("native_zoom", T.native_zoom("web_bbox", "width"))
        .drop("__web", "__box")
    )


def finite_only(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(G.is_finite(c))
    return df


def extent(df: DataFrame, by: tuple[str, ...] = (), ring: str | None = "native_ring", box: str | None = None) -> DataFrame:
    """Box around all finite points per group, null if a group has none.

    Points are reduced inside the row first, so nothing is exploded and the shuffle carries one row per
    group and task.
    """
    own = F.col(box) if ring is None else G.ring_bbox(ring)
    points = df.select(*by, own.alias("__b"))
    merged = points.groupBy(*by).agg(
        F.min("__b.xmin").alias("xmin"),
        F.min("__b.ymin").alias("ymin"),
        F.max("__b.xmax").alias("xmax"),
        F.max("__b.ymax").alias("ymax"),
    )
    whole = F.when(F.col("xmin").isNotNull(), G.bbox("xmin", "ymin", "xmax", "ymax"))
    return merged.select(*by, whole.alias("extent"))


def group_by_epsg(df: DataFrame, by: tuple[str, ...] = ("collection_id",), web: str = "web_ring") -> DataFrame:
    """Native and web counts per EPSG code; a missing code is a group of its own."""
    return df.groupBy(*by, "epsg").agg(
        F.count(F.lit(1)).alias("native_count"), F.count_if(F.col(web).isNotNull()).alias("web_count")
    )


def distinct_epsgs(df: DataFrame, by: tuple[str, ...] = (), epsg: str = "epsg") -> DataFrame:
    """Known codes in use, sorted. Codes are reduced to distinct values before they are gathered."""
    known = df.where(F.col(epsg).isNotNull()).select(*by, F.col(epsg).cast("int").alias(epsg)).distinct()
    return known.groupBy(*by).agg(F.array_sort(F.collect_list(epsg)).alias("epsgs"))


def fill_epsg(df: DataFrame, override: int = 0, by: str = "collection_id") -> DataFrame:
    """Fill missing codes: with ``override`` if given, else with the only code the collection has.

    A collection with several codes keeps its gaps. Only min and max of the known codes are needed, one
    small row per collection.
    """
    if override:
        return df.withColumn("epsg", F.coalesce("epsg", F.lit(override)))
    only = (
        df.groupBy(by)
        .agg(F.min("epsg").alias("__lo"), F.max("epsg").alias("__hi"))
        .select(by, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).alias("__only"))
    )
    return df.join(only, by, "left").withColumn("epsg", F.coalesce("epsg", "__only")).drop("__only").select(*df.columns)


def native_web_join(native: DataFrame, web: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """Index rows: native rows that have a web copy. If a key repeats among the copies, the last one wins."""
    chosen = web if order is None else ranks.last_wins(web, key, order).drop(order)
    return native.join(chosen, key)


def dropped_web(native: DataFrame, web: DataFrame, key: str = "key") -> DataFrame:
    """Native rows without a web copy."""
    return native.join(web.select(key), key, "left_anti")


def index_rows(footprints: DataFrame) -> DataFrame:
    """Rows for the footprint table: both geometries present and the CRS known."""
    return footprints.where(F.col("web_ring").isNotNull() & F.col("epsg").isNotNull()).select(
        F.col("collection_id"),
        F.col("location"),
        F.col("file_name"),
        F.col("key"),
        F.col("epsg").alias("native_epsg"),
        F.col("web_bbox").alias("bbox"),
        F.col("web_ring").alias("geom"),
        F.col("native_ring").alias("geom_native"),
    )


def median_native_zoom(df: DataFrame, by: tuple[str, ...] = ("collection_id",), zoom: str = "native_zoom") -> DataFrame:
    """Upper median of the zooms, rounded half-even; 18 where a group has none."""
    found = ranks.rank_percentiles(df, zoom, {"median": 0.5}, by)
    rounded = F.bround("median").cast("int")
    groups = df.select(*by).distinct() if by else None
    if groups is None:
        return found.agg(F.coalesce(F.max(rounded), F.lit(T.DEFAULT_NATIVE_ZOOM)).alias("native_zoom"))
    return groups.join(found, list(by), "left").select(
        *by, F.coalesce(rounded, F.lit(T.DEFAULT_NATIVE_ZOOM)).alias("native_zoom")
    )


def scan_report(results: DataFrame, shown: int = 20) -> DataFrame:
    """One row over scan results (``key, error, web_ring``): totals and the first failures in key order.

    A scan is publishable only when nothing failed.
    """
    failed = F.col("error").isNotNull()
    totals = results.agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(~failed).alias("scanned"),
        F.count_if(failed).alias("failures"),
        F.count_if(~failed & F.col("web_ring").isNull()).alias("dropped_web"),
    )
    first = (
        results.where(failed).orderBy("key").limit(shown)
        .agg(F.array_sort(F.collect_list(F.struct("key", "error"))).alias("s"))
        .select(F.transform("s", lambda r: r["error"]).alias("first_failures"))
    )
    return totals.select(
        "*", first.scalar().alias("first_failures"), (F.col("failures") == 0).alias("publishable")
    )
