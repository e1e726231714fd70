"""Staging of a footprint lake: selections, staged columns, spatial order, per-selection summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geometry as G
from ..functions import text as X
from ..functions.wkb import wkb_box

YEAR_RANGE = (1900, 2100)
SELECTION_SCHEMA = "state string, year string, uri string, label string"


def judged_selections(raw: DataFrame) -> DataFrame:
    """Normalised selections with a ``problem`` column, null for good rows.

    ``raw`` has ``state, year`` (as text), ``uri, label``. Selections are configuration; the window over their
    keys sees a handful of rows.
    """
    state = F.lower(F.trim(F.coalesce("state", F.lit(""))))
    year = F.col("year").cast("string").try_cast("int")
    shaped = raw.select(state.alias("state"), F.col("year").alias("__year"), year.alias("year"), "uri", "label")
    joined = shaped.withColumn("__copies", F.count(F.lit(1)).over(W.partitionBy("state", "year")))
    problem = (
        F.when(~F.col("state").rlike(X.STATE_CODE), F.concat(F.lit("invalid state code: "), F.col("state")))
        .when(F.col("year").isNull(), F.concat(F.lit("invalid year for "), F.col("state"), F.lit(": "), F.coalesce("__year", F.lit("null"))))
        .when(~F.col("year").between(*YEAR_RANGE), F.concat(F.lit("year out of range for "), F.col("state"), F.lit(": "), F.col("year").cast("string")))
        .when(F.col("__copies") > 1, F.concat(F.lit("duplicate parquet selection: "), F.col("state"), F.lit(":"), F.col("year").cast("string")))
    )
    return joined.select("state", "year", "uri", "label", problem.alias("problem"))


def validate_selections(raw: DataFrame) -> DataFrame:
    """Good selections ordered by year and state; any bad row, or no row at all, is an error.

    Selections are a small configuration, so checking them runs a short job.
    """
    judged = judged_selections(raw)
    found = judged.agg(F.count(F.lit(1)).alias("n"), F.min("problem").alias("problem")).first()
    if not found["n"]:
        raise ValueError("at least one state/year selection is required")
    if found["problem"] is not None:
        raise ValueError(found["problem"])
    return ordered_selections(judged.drop("problem"))


def ordered_selections(selections: DataFrame) -> DataFrame:
    return selections.orderBy("year", "state")


def selected_partitions(lake: DataFrame, selections: DataFrame) -> DataFrame:
    """Lake rows of the selected (region, year) partitions.

    A semi-join on partition columns. When the selections turn out small at run time they are broadcast and
    prune the partitions to read; no size is assumed here.
    """
    wanted = selections.select(F.col("state").alias("region"), F.col("year").cast("int").alias("year")).distinct()
    return lake.join(wanted, ["region", "year"], "left_semi")


def with_boxes(rows: DataFrame, box: str = "bbox", geometry: str = "geometry") -> DataFrame:
    """Lake rows with a box: the one they carry, else that of their binary geometry, null where there is none."""
    if box in rows.columns or geometry not in rows.columns:
        return rows
    found = rows.withColumn("__box", wkb_box(geometry))
    known = F.col("__box.xmin").isNotNull() & ~F.isnan("__box.xmin")
    return found.withColumn(box, F.when(known, F.col("__box"))).drop("__box")


def staged_columns(
    rows: DataFrame, proxy_base: str, access_mode: str = "requester-pays", region: str = "us-west-2"
) -> DataFrame:
    """Add ``location`` and ``tile_srs`` to lake rows."""
    if access_mode not in ("requester-pays", "standard"):
        raise ValueError("access mode must be requester-pays or standard")
    return rows.withColumns(
        {
            "location": X.staged_location(
                F.lit(proxy_base), F.lit(access_mode), F.lit(region), F.col("source_bucket"), F.col("source_key")
            ),
            "tile_srs": X.tile_srs("proj_epsg"),
        }
    )


def cluster_spatially(
    df: DataFrame, box: str = "bbox", partitions: int | None = None, world: float = 20037508.342789244,
    leading: tuple[str, ...] = (), tie: tuple[str, ...] = (),
) -> DataFrame:
    """Rows in Z-order of their box centre.

    ``leading`` columns (usually the output partitions) come first. The box edges and ``tie`` columns
    follow the Z value in the range key, so that a pile of footprints in one place is still split.
    """
    keys = [*leading, "__z", f"{box}.xmin", f"{box}.ymin", *tie]
    numbered = df.withColumn("__z", G.z_order(box, world))
    ranged = numbered.repartitionByRange(partitions, *keys) if partitions else numbered.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys).drop("__z")


def index_summary(rows: DataFrame, by: tuple[str, ...] = ("region", "year"), box: str = "bbox") -> DataFrame:
    """Extent, count, codes and cut 3857 extent of every selection, in one pass over the rows.

    Codes are first reduced to distinct values per selection; the two steps share one shuffle key.
    """
    per_code = rows.groupBy(*by, F.col("proj_epsg").cast("int").alias("__epsg")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(f"{box}.xmin").alias("xmin"),
        F.min(f"{box}.ymin").alias("ymin"),
        F.max(f"{box}.xmax").alias("xmax"),
        F.max(f"{box}.ymax").alias("ymax"),
    )
    merged = per_code.groupBy(*by).agg(
        F.sum("n").alias("cog_count"),
        F.array_sort(F.collect_list("__epsg")).alias("native_epsgs"),
        G.bbox(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).alias("bbox_4326"),
    )
    return merged.withColumn("extent_3857", G.truncate_bbox(C.lonlat_bbox_to_web("bbox_4326")))


def resolve_uris(selections: DataFrame, template: str) -> DataFrame:
    """``resolved_uri``: the explicit one, else the template with ``{state}`` and ``{year}`` filled in."""
    filled: Column = F.replace(F.lit(template), F.lit("{state}"), F.col("state"))
    filled = F.replace(filled, F.lit("{year}"), F.col("year").cast("string"))
    return selections.withColumn("resolved_uri", F.coalesce(F.nullif("uri", F.lit("")), filled))
