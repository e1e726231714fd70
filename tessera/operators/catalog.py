"""Catalog algebra.

A catalog is a DataFrame with one row per collection: ``position bigint`` (order in the document),
``id string`` and ``fields map<string,variant>`` (everything the document says about it). A key that is
absent from the map is absent from the document, which is different from a null value; merging keeps
that difference, and unknown fields survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import tiles as T
from . import tilegen

CATALOG_SCHEMA = "position bigint, id string, fields map<string,variant>"

# Fixed values used where a collection says nothing.
DEFAULT_EXTENT_3857 = (-14000000.0, 2500000.0, -7000000.0, 6000000.0)
DEFAULT_DRAW_ORDER = 10
BASE_EPSGS = (3857, 4326)

_GROUP = (
    "array<struct<epsg:int,tileindex:string,tileindex_layer_name:string,layer_name:string,"
    "extent_native:array<double>,cog_count:bigint,tileitem:string,tilesrs:string,mixed_srs:boolean>>"
)
TYPED_FIELDS = {
    "layer_name": "string", "layer_names": "array<string>", "map_name": "string", "label": "string",
    "attribution": "string", "enabled": "boolean", "min_zoom": "int", "max_zoom": "int", "native_zoom": "int",
    "draw_order": "int", "native_epsg": "int", "native_epsgs": "array<int>", "cog_count": "bigint",
    "bbox_4326": "array<double>", "extent_3857": "array<double>", "extent_native": "array<double>",
    "tileindex": "string", "tileindex_geojson": "string", "tileindex_layer_name": "string", "tileindexes": _GROUP,
    "postgis": "boolean", "parquet": "boolean", "indexed_at": "string", "raster_processing": "array<string>",
    "group": "string",
    "source": "struct<bucket:string,prefix:string,region:string,access_mode:string,requester_pays:boolean>",
}


def field(name: str, kind: str) -> Column:
    return F.try_variant_get(F.col("fields")[name], "$", kind)


def typed(catalog: DataFrame) -> DataFrame:
    """The known fields as columns, null where absent or of another type."""
    return catalog.select("position", "id", *[field(n, t).alias(n) for n, t in TYPED_FIELDS.items()])


def untyped(rows: DataFrame, position: Column | None = None, present: tuple[str, ...] = ()) -> DataFrame:
    """Catalog rows from plain columns, ``id`` is required.

    A null column counts as absent, but for those in ``present``: their null is a value, and overrides what a merge
    finds (a rescan without any extent must not keep the old one).
    """
    names = [c for c in rows.columns if c != "position"]

    def entry(n: str) -> Column:
        one = F.map_from_arrays(F.array(F.lit(n)), F.array(_variant(n)))
        if n in present:
            return F.coalesce(F.when(F.col(n).isNotNull(), one), F.map_from_arrays(F.array(F.lit(n)), F.array(F.parse_json(F.lit("null")))))
        return F.when(F.col(n).isNotNull(), one)

    parts = [entry(n) for n in names]
    empty = F.expr("cast(map() as map<string,variant>)")
    at = F.col("position").cast("bigint") if position is None else position
    return rows.select(at.alias("position"), "id", F.map_concat(*[F.coalesce(p, empty) for p in parts]).alias("fields"))


def _variant(name: str) -> Column:
    """A column of any type as a variant, through its JSON form."""
    boxed = F.from_json(F.to_json(F.struct(F.col(name).alias("v"))), "map<string,variant>")
    return boxed["v"]


def upsert_catalog(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Insert or shallow-merge entries by id.

    Keys of the entry win, keys it lacks survive. Existing collections keep their place, new ones follow
    in the entries' order.
    """
    new = entries.select(F.col("position").alias("__at"), "id", F.col("fields").alias("__new"))
    end = catalog.agg(F.coalesce(F.max("position") + 1, F.lit(0).cast("bigint")).alias("n")).scalar()
    kept = F.when(
        F.col("__new").isNull(), F.col("fields")
    ).otherwise(F.map_filter("fields", lambda k, _v: ~F.array_contains(F.map_keys("__new"), k)))
    merged = (
        F.when(F.col("fields").isNull(), F.col("__new"))
        .when(F.col("__new").isNull(), F.col("fields"))
        .otherwise(F.map_concat(kept, F.col("__new")))
    )
    return catalog.join(new, "id", "full").select(
        F.coalesce("position", F.col("__at") + end).alias("position"), "id", merged.alias("fields")
    )


def delete_collection(catalog: DataFrame, collection_id: str) -> DataFrame:
    """The catalog without one collection; an unknown id is an error (checked by a short job)."""
    if catalog.where(F.col("id") == collection_id).isEmpty():
        raise ValueError(f"Collection {collection_id} not found")
    return catalog.where(~F.col("id").eqNullSafe(collection_id))


def enabled_collections(collections: DataFrame) -> DataFrame:
    """Collections not switched off; silence means enabled."""
    return collections.where(F.coalesce("enabled", F.lit(True)))


def draw_order() -> list[Column]:
    """Sort keys: draw order (10 if absent), then document position."""
    return [F.coalesce("draw_order", F.lit(DEFAULT_DRAW_ORDER)).asc(), F.col("position").asc()]


def in_draw_order(collections: DataFrame) -> DataFrame:
    return collections.orderBy(*draw_order())


def active_collection(collections: DataFrame, configured: str | None = None, explicit: str | None = None) -> DataFrame:
    """The one active collection: configured, else explicit, else the first enabled one in draw order, else the first.

    A single minimum over a priority key: no sort and no window.
    """
    enabled = F.coalesce("enabled", F.lit(True))
    rank = (
        F.when(F.col("id") == F.lit(configured), F.lit(0))
        .when(F.col("id") == F.lit(explicit), F.lit(1))
        .when(enabled, F.lit(2))
        .otherwise(F.lit(3))
    )
    order = F.when(rank == 2, F.coalesce("draw_order", F.lit(DEFAULT_DRAW_ORDER))).otherwise(F.lit(0))
    key = F.struct(rank.alias("rank"), order.alias("order"), F.col("position"))
    packed = F.struct(*[F.col(c) for c in collections.columns])
    return collections.agg(F.min_by(packed, key).alias("c")).where("c IS NOT NULL").select("c.*")


def catalog_extent(collections: DataFrame, default=DEFAULT_EXTENT_3857) -> DataFrame:
    """Union of the 3857 extents of the enabled collections that have one, else a default area."""
    e = F.col("extent_3857")
    merged = enabled_collections(collections).where(F.size(e) == 4).agg(
        F.min(e[0]).alias("xmin"), F.min(e[1]).alias("ymin"), F.max(e[2]).alias("xmax"), F.max(e[3]).alias("ymax")
    )
    return merged.select(
        *[F.coalesce(F.col(n), F.lit(float(d))).alias(n) for n, d in zip(G.BBOX_FIELDS, default)]
    )


def with_groups(collections: DataFrame) -> DataFrame:
    """``groups``: the collection's index groups, or one made from its top-level fields."""
    one = F.array(
        F.struct(
            F.col("native_epsg").alias("epsg"),
            F.coalesce("tileindex", "tileindex_geojson").alias("tileindex"),
            F.col("tileindex_layer_name"),
            F.coalesce("layer_name", "id").alias("layer_name"),
            F.col("extent_native"),
            F.lit(None).cast("bigint").alias("cog_count"),
            F.lit(None).cast("string").alias("tileitem"),
            F.lit(None).cast("string").alias("tilesrs"),
            F.lit(None).cast("boolean").alias("mixed_srs"),
        )
    )
    return collections.withColumn(
        "groups", F.when(F.size("tileindexes") > 0, F.col("tileindexes")).otherwise(one)
    )


def collection_groups(collections: DataFrame) -> DataFrame:
    """Collection x index group, with the names the map server uses for each."""
    flat = with_groups(collections).select("*", F.size("groups").alias("group_count"), F.explode("groups").alias("grp"))
    return flat.select(
        "id",
        F.col("grp.epsg").alias("epsg"),
        F.coalesce("grp.tileindex", "tileindex", "tileindex_geojson").alias("tileindex"),
        F.coalesce("grp.tileindex_layer_name", "tileindex_layer_name", X.file_stem(F.coalesce("grp.tileindex", "tileindex"))).alias("tileindex_layer_name"),
        F.coalesce("grp.layer_name", "layer_name", "id").alias("layer_name"),
        X.layer_name(F.concat(F.lit("cog-tileindex-"), F.col("id")), F.col("grp.epsg"), F.col("group_count")).alias("index_layer"),
        F.coalesce("grp.tileitem", F.lit("location")).alias("tileitem"),
        F.col("grp.tilesrs").alias("tilesrs"),
        F.coalesce("grp.mixed_srs", F.lit(False)).alias("mixed_srs"),
        X.default_processing("raster_processing").alias("processing"),
    )


def srs_set(collections: DataFrame) -> DataFrame:
    """Codes the service declares: the two web ones and every native one of enabled collections, sorted."""
    native = with_groups(enabled_collections(collections)).select(F.explode("groups").alias("g")).select(
        F.col("g.epsg").alias("epsg")
    )
    base = collections.sparkSession.createDataFrame([(e,) for e in BASE_EPSGS], "epsg int")
    return base.union(native.where("epsg IS NOT NULL")).distinct().orderBy("epsg")


def catalog_to_ui(collections: DataFrame, now: Column) -> DataFrame:
    s = F.col("source")
    name = F.coalesce(F.nullif("layer_name", F.lit("")), F.col("id"))
    given = F.nullif(F.col("layer_names"), F.array().cast("array<string>"))
    return collections.select(
        F.col("id").alias("collectionName"),
        name.alias("layerName"),
        F.coalesce(given, F.array(name)).alias("layerNames"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.col("min_zoom").alias("minZoom"),
        F.col("max_zoom").alias("maxZoom"),
        F.coalesce("draw_order", F.lit(DEFAULT_DRAW_ORDER)).alias("drawOrder"),
        X.status_text("cog_count", "indexed_at", "postgis", "parquet", now).alias("status"),
        F.struct(
            F.coalesce(F.nullif("label", F.lit("")), F.col("id")).alias("label"),
            s["bucket"].alias("bucket"),
            s["prefix"].alias("prefix"),
            F.coalesce(s["region"], F.lit("us-west-2")).alias("region"),
            F.coalesce(s["access_mode"], F.lit("unsigned")).alias("accessMode"),
            F.coalesce(s["requester_pays"], F.lit(False)).alias("requesterPays"),
        ).alias("source"),
    )


def catalog_to_viewer(collections: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("layer_name", F.lit("")), F.col("id"))
    given = F.nullif(F.col("layer_names"), F.array().cast("array<string>"))
    box = G.bbox_from_array("bbox_4326")
    center = F.array(*[F.lit(v) for v in tilegen.FALLBACK_CENTER])
    return collections.select(
        F.col("id").alias("collectionId"),
        F.col("id").alias("collectionName"),
        F.coalesce(F.nullif("map_name", F.lit("")), F.lit("imagery")).alias("mapName"),
        name.alias("layerName"),
        F.coalesce(given, F.array(name)).alias("layerNames"),
        G.bounds_from_bbox(box, tilegen.fallback_bounds()).alias("bounds"),
        G.center_from_bbox(box, center).alias("center"),
        F.coalesce(F.nullif(F.col("min_zoom"), F.lit(0)), F.lit(14)).alias("imageryMinZoom"),
        F.col("max_zoom").alias("imageryMaxZoom"),
        F.coalesce("native_zoom", F.lit(T.DEFAULT_NATIVE_ZOOM)).alias("nativeZoom"),
        F.coalesce("attribution", F.lit("")).alias("attribution"),
    )


def backend_summary(active: DataFrame, database: bool = False) -> DataFrame:
    """What serves the active collection: backend, count, codes and index files."""
    db = F.lit(database) & F.coalesce("postgis", F.lit(False))
    files = F.filter(F.transform("tileindexes", lambda g: X.file_name(g["tileindex"])), lambda n: F.coalesce(n, F.lit("")) != "")
    listed = F.nullif(F.array_join(F.coalesce(files, F.array().cast("array<string>")), ", "), F.lit(""))
    codes = F.nullif(F.col("native_epsgs"), F.array().cast("array<int>"))
    single = F.when(F.coalesce("native_epsg", F.lit(0)) != 0, F.array("native_epsg")).otherwise(F.array().cast("array<int>"))
    return active.select(
        F.col("id").alias("activeCollection"),
        F.when(db, F.lit("PostGIS"))
        .when(F.coalesce("parquet", F.lit(False)), F.lit("GeoParquet"))
        .otherwise(F.lit("FlatGeobuf"))
        .alias("backend"),
        F.coalesce("cog_count", F.lit(0).cast("bigint")).alias("cogCount"),
        F.coalesce(codes, single).alias("nativeEpsgs"),
        F.when(db, F.lit("cog_index"))
        .otherwise(F.coalesce(listed, X.file_name(F.coalesce("tileindex", "tileindex_geojson")), F.lit("")))
        .alias("indexSource"),
    )
