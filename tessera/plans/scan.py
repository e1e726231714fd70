"""Collection scan: headers -> footprints -> tile index, footprint table and catalog entry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geometry as G
from ..functions import text as X
from ..functions import tiles as T
from ..operators import catalog as K
from ..operators import footprints as P
from ..operators import ranks
from ..session import materialize
from ..sinks import writers


@dataclass
class ScanSettings:
    collection: str
    bucket: str = ""
    prefix: str = ""
    region: str = "us-west-2"
    proxy_base: str = "http://localhost:8001"
    access_mode: str = "unsigned"
    source_epsg: int = 0
    label: str | None = None
    attribution: str = ""
    layer_name: str | None = None
    map_name: str | None = None
    min_zoom: int | None = None
    max_zoom: int | None = None
    draw_order: int = 10
    enabled: bool = True
    index_path: str = ""
    extras: dict = field(default_factory=dict)

    @property
    def requester_pays(self) -> bool:
        return self.access_mode == "requester-pays"


def _int_box(box: Column) -> Column:
    """Edges rounded to whole numbers; null unless all four are finite."""
    ok = G.is_finite(box["xmin"]) & G.is_finite(box["ymin"]) & G.is_finite(box["xmax"]) & G.is_finite(box["ymax"])
    return F.when(ok, F.array(*[F.bround(box[f], 0).cast("bigint") for f in G.BBOX_FIELDS]))


def collection_facts(footprints: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """Everything a catalog entry derives from footprints, one row per collection.

    Group extents and counts are reduced per EPSG code first; the collection level is computed from those
    few rows. Extents and the zoom median, which reads its rows several times, need a box or a number of each footprint;
    these are written to the shared folder once, so footprints that are still to be reprojected are made once.
    """
    facts = materialize(
        footprints.select(*by, "epsg", G.ring_bbox("native_ring").alias("n"), G.ring_bbox("web_ring").alias("w"), "native_zoom"), "facts"
    )
    per_code = facts.groupBy(*by, "epsg").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[agg(f"{b}.{f}").alias(f"{b}_{f}") for b in ("n", "w") for f, agg in zip(G.BBOX_FIELDS, (F.min, F.min, F.max, F.max))],
    )

    def box(prefix: str, fold) -> Column:
        low, high = fold
        parts = [low(f"{prefix}_xmin"), low(f"{prefix}_ymin"), high(f"{prefix}_xmax"), high(f"{prefix}_ymax")]
        return F.when(parts[0].isNotNull(), G.bbox(*parts))

    plain = (F.col, F.col)
    rows = per_code.groupBy(*by).agg(
        F.sum("n_rows").alias("cog_count"),
        box("n", (F.min, F.max)).alias("n"),
        box("w", (F.min, F.max)).alias("w"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("epsg").isNotNull(),
                    F.struct("epsg", G.bbox_array(G.round_bbox(box("n", plain), 2)).alias("extent_native"), F.col("n_rows").alias("cog_count")),
                )
            )
        ).alias("groups"),
    )
    web = G.round_bbox("w", 0)
    zooms = ranks.rank_percentiles(facts, "native_zoom", {"median": 0.5}, by)
    zoom = F.coalesce(F.bround("median").cast("int"), F.lit(T.DEFAULT_NATIVE_ZOOM))
    return rows.join(zooms, list(by), "left").select(
        *by,
        "cog_count",
        G.bbox_array(G.round_bbox("n", 2)).alias("extent_native"),
        _int_box(web).alias("extent_3857"),
        G.bbox_array(G.round_bbox(C.web_bbox_to_lonlat(web), 4)).alias("bbox_4326"),
        F.transform("groups", lambda g: g["epsg"]).alias("native_epsgs"),
        "groups",
        zoom.alias("native_zoom"),
    )


def collection_entry(footprints: DataFrame, s: ScanSettings, indexed_at: Column | None = None, postgis: bool = False) -> DataFrame:
    """Catalog row (``position, id, fields``) of a scanned collection."""
    facts = collection_facts(footprints)
    stamp = F.date_format(F.to_utc_timestamp(indexed_at if indexed_at is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    slug = X.slugify(F.lit(s.collection))
    layer = F.lit(s.layer_name) if s.layer_name else slug
    label = s.label or s.collection
    n_groups = F.size("groups")
    stem = s.index_path or f"{s.collection}_tileindex"

    def group(g: Column) -> Column:
        return F.struct(
            g["epsg"].alias("epsg"),
            F.concat(F.lit(f"{stem}/collection_id={s.collection}/native_epsg="), g["epsg"].cast("string")).alias("tileindex"),
            X.index_layer_name(F.lit(s.collection), g["epsg"]).alias("tileindex_layer_name"),
            X.layer_name(layer, g["epsg"], n_groups).alias("layer_name"),
            g["extent_native"].alias("extent_native"),
            g["cog_count"].alias("cog_count"),
        )

    zooms = T.zoom_range("native_zoom", F.lit(s.min_zoom), F.lit(s.max_zoom))
    provider = F.array(F.struct(F.lit(s.attribution or "Unknown").alias("name"), F.array(F.lit("producer"), F.lit("host")).alias("roles")))
    entry = facts.select(
        F.lit("Collection").alias("type"),
        F.lit("1.0.0").alias("stac_version"),
        F.col("collection_id").alias("id"),
        F.lit(label).alias("title"),
        F.lit(f"COG collection '{s.collection}' scanned from S3").alias("description"),
        F.lit("various").alias("license"),
        F.struct(
            F.struct(F.filter(F.array("bbox_4326"), lambda b: b.isNotNull()).alias("bbox")).alias("spatial"),
            F.struct(F.array(F.array(stamp, stamp)).alias("interval")).alias("temporal"),
        ).alias("extent"),
        F.array(
            F.struct(F.lit("self").alias("rel"), F.lit(f"./{s.collection}.json").alias("href"), F.lit("application/json").alias("type"))
        ).alias("links"),
        (provider if s.attribution else F.slice(provider, 1, 0)).alias("providers"),
        layer.alias("layer_name"),
        F.transform("groups", lambda g: X.layer_name(layer, g["epsg"], n_groups)).alias("layer_names"),
        (F.lit(s.map_name) if s.map_name else F.concat(slug, F.lit("-imagery"))).alias("map_name"),
        F.lit(label).alias("label"),
        F.lit(s.attribution).alias("attribution"),
        F.lit(s.enabled).alias("enabled"),
        zooms["min_zoom"].alias("min_zoom"),
        zooms["max_zoom"].alias("max_zoom"),
        "native_zoom",
        F.lit(s.draw_order).alias("draw_order"),
        F.struct(
            F.lit(s.bucket).alias("bucket"), F.lit(s.prefix).alias("prefix"), F.lit(s.region).alias("region"),
            F.lit(s.access_mode).alias("access_mode"), F.lit(s.requester_pays).alias("requester_pays"),
        ).alias("source"),
        F.col("native_epsgs")[0].alias("native_epsg"),
        "native_epsgs",
        "cog_count",
        "bbox_4326",
        "extent_3857",
        "extent_native",
        F.transform("groups", group).alias("tileindexes"),
        F.lit(postgis).alias("postgis"),
        stamp.alias("indexed_at"),
    )
    first = F.col("tileindexes")[0]
    named = entry.withColumns({"tileindex": first["tileindex"], "tileindex_layer_name": first["tileindex_layer_name"]})
    return K.untyped(named, F.lit(0).cast("bigint"), present=("extent_native", "extent_3857", "bbox_4326"))


def scan_collection(headers: DataFrame, s: ScanSettings, index_path: str, table_path: str | None = None, catalog_path: str | None = None) -> dict:
    """Run a scan: report, tile index, footprint table and catalog entry. Any failed header publishes nothing.

    ``headers`` may carry an ``error`` column with the reason a file could not be read.
    """
    if "error" not in headers.columns:
        headers = headers.withColumn("error", F.lit(None).cast("string"))
    good = P.build_footprints(
        headers.where("error IS NULL"), s.collection, s.region, s.proxy_base, s.requester_pays, s.source_epsg, fill_gaps=True
    )
    # The footprints feed the report, both indexes and the entry: write them once to the shared folder.
    footprints = materialize(good, "footprints")
    results = footprints.select("key", F.lit(None).cast("string").alias("error"), "web_ring").union(
        headers.where("error IS NOT NULL").select("key", "error", F.lit(None).cast("array<struct<x:double,y:double>>"))
    )
    report = P.scan_report(results).first().asDict()
    if not report["discovered"]:
        raise RuntimeError("No GeoTIFFs found")
    if report["failures"]:
        raise RuntimeError(f"Failed to scan {report['failures']} files: {report['first_failures']}")
    if footprints.where("epsg IS NOT NULL").isEmpty():
        raise RuntimeError("No source EPSG values detected; give one or inspect the source CRS metadata.")
    writers.write_tile_index(footprints.withColumnRenamed("epsg", "native_epsg"), index_path)
    if table_path:
        report["loaded"] = writers.replace_collection(P.index_rows(footprints), table_path, s.collection)
    if catalog_path:
        s.index_path = s.index_path or index_path
        writers.upsert_catalog_document(collection_entry(footprints, s, postgis=bool(table_path)), catalog_path)
    return report
