"""Tile x footprint join, hit counts, coverage and tile classes.

The join never compares all pairs. A footprint is placed on a grid whose cells are one tile wide, or
``2^shift`` tiles wide when the footprint is large, so that it falls into a bounded number of cells; a
tile belongs to exactly one cell per grid in use. Both sides meet in an equi-join on the cell, followed
by the exact test. Each true pair appears exactly once, whatever the sizes, so no de-duplication is
needed, and a hot cell is an ordinary skewed join key that adaptive execution splits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from ..functions import crs as C
from ..functions import geometry as G
from ..functions import polygons as P
from ..functions import tiles as T

# Fixed values of the classification.
MAX_READABLE_HITS = 4
COVERAGE_THRESHOLD = 0.999
TILE_CLASSES = ("empty", "interior", "seam", "partial", "too_many")

CELLS_PER_AXIS = 8
SHIFT_STEP = 3
#: Tiles of a run: what stands for a column of tiles until it is opened.
RUN_BITS = 8
RUN = 1 << RUN_BITS
#: The summary of a tile without hits.
NO_HITS = {"cog_count": "0L", "inside_one": "false", "coverage": "CAST(NULL AS DOUBLE)"}
# Candidate cells are widened by this share of a cell, so that rounding in the cell arithmetic can
# never lose a pair; the exact test removes what the widening adds.
CELL_SLACK = 1e-6


def place_footprints(footprints: DataFrame, box: str, zoom) -> DataFrame:
    """Add the closed tile range (``__x0..__y1``) and the grid ``__shift`` of every footprint.

    Rows whose box is missing or not finite touch nothing and are left out.
    """
    finite = " AND ".join(f"NOT isnan({box}.{f}) AND abs({box}.{f}) < double('infinity')" for f in G.BBOX_FIELDS)
    e, slack = f"{T.WEB_EXTENT!r}D", f"{CELL_SLACK!r}D"
    ranged = footprints.where(finite).withColumn("__size", T.tile_size(zoom)).selectExpr(
        "*",
        f"CAST(floor(({box}.xmin + {e}) / __size - {slack}) AS BIGINT) AS __x0",
        f"CAST(floor(({box}.xmax + {e}) / __size + {slack}) AS BIGINT) AS __x1",
        f"CAST(floor(({e} - {box}.ymax) / __size - {slack}) AS BIGINT) AS __y0",
        f"CAST(floor(({e} - {box}.ymin) / __size + {slack}) AS BIGINT) AS __y1",
    )
    span = f"(greatest(__x1 - __x0, __y1 - __y0) + 1) / {float(CELLS_PER_AXIS)}D"
    steps = f"CAST(ceil(greatest(ceil(log2({span})), 0L) / {float(SHIFT_STEP)}D) AS INT)"
    return ranged.drop("__size").selectExpr("*", f"{steps} * {SHIFT_STEP} AS __shift")


def _cells(low: str, high: str) -> Column:
    return F.explode(
        F.sequence(
            F.call_function("shiftright", F.col(low), F.col("__shift")),
            F.call_function("shiftright", F.col(high), F.col("__shift")),
        )
    )


def _grid(zoom: Column) -> Column:
    """Zoom and cell width as one key; non-null, so that no null test drags its formula into the scan."""
    return F.coalesce(zoom.cast("int") * 64 + F.col("__shift"), F.lit(-1)).alias("__grid")


def tile_footprint_join(
    tiles: DataFrame,
    footprints: DataFrame,
    zoom,
    box: str = "bbox",
    on: tuple[str, ...] = (),
    ring: str | None = None,
    max_shift: int | None = None,
) -> DataFrame:
    """All (tile, footprint) pairs that intersect; touching counts.

    ``tiles`` has ``z, x, y`` (distinct per ``on``); ``footprints`` has the 3857 box column ``box`` and, for
    exact polygon tests, the 3857 ring column ``ring`` (a convex quadrilateral, closed, within ``box``). ``zoom`` is the tiles'
    zoom, as a number or as a column of ``footprints``. ``on`` names further equality keys, such as the
    collection. ``max_shift`` may state the coarsest grid when it is known (0 for footprints narrower
    than eight tiles); otherwise it is read from the footprints as a one-row subquery. Both sides are shuffled to the
    cells, whatever their sizes: the planner would take a grid generated from one row for as small as that row and
    broadcast it. Adaptive execution splits skewed cells.

    The result has the tile's columns with its box as ``tile_bbox``, and the footprint's other columns.
    """
    placed = place_footprints(footprints, box, zoom)
    if max_shift is None:
        coarsest = placed.agg(F.coalesce(F.max("__shift"), F.lit(0)).alias("m")).scalar()
    else:
        coarsest = F.lit(max_shift)
    kept = [c for c in footprints.columns if c not in on]
    if ring is not None:
        # Before the explode: once per footprint, not once per pair.
        placed = placed.withColumn("__planes", G.half_planes(ring))
        kept = [*kept, "__planes"]
    keys = ["__grid", "__cx", "__cy", *on]
    right = (
        placed.select("*", _cells("__x0", "__x1").alias("__cx"))
        .select("*", _cells("__y0", "__y1").alias("__cy"))
        .select(*kept, *on, _grid(T.col(zoom)), "__cx", "__cy")
    )
    left = (
        tiles.withColumn("__shift", F.explode(F.sequence(F.lit(0), coarsest, F.lit(SHIFT_STEP))))
        .withColumn("__cx", F.call_function("shiftright", F.col("x").cast("bigint"), F.col("__shift")))
        .withColumn("__cy", F.call_function("shiftright", F.col("y").cast("bigint"), F.col("__shift")))
        .select(*tiles.columns, _grid(F.col("z")), "__cx", "__cy")
    )
    pairs = left.hint("merge").join(right, keys).withColumn("tile_bbox", T.tile_bbox("x", "y", "z"))
    hits = pairs.where(G.bbox_intersects("tile_bbox", box))
    if ring is not None:
        hits = hits.where(~G.box_misses_planes("tile_bbox", "__planes"))
    return hits.select(*tiles.columns, "tile_bbox", *kept)


def range_footprint_join(
    ranges: DataFrame, footprints: DataFrame, zoom, box: str = "bbox", on: tuple[str, ...] = (), ring: str | None = None, rng: str = "range",
) -> DataFrame:
    """``tile_footprint_join`` for tiles that are the whole grid of a range (one row of ``ranges`` for each ``on``).

    Whether a tile is one of the grid is a comparison with the range, so a footprint names its tiles itself: no tile without
    a footprint is made, and only footprints are shuffled, cut into blocks where they are large.
    """
    placed = place_footprints(footprints, box, zoom)
    kept = [c for c in footprints.columns if c not in on]
    if ring is not None:
        placed = placed.withColumn("__planes", G.half_planes(ring))
        kept = [*kept, "__planes"]
    pairs = _range_tiles(placed, ranges, zoom, on, rng).withColumn("tile_bbox", T.tile_bbox("x", "y", "z"))
    hits = pairs.where(G.bbox_intersects("tile_bbox", box))
    if ring is not None:
        hits = hits.where(~G.box_misses_planes("tile_bbox", "__planes"))
    return hits.select(*_keys(on), "tile_bbox", *kept)


def _range_tiles(placed: DataFrame, ranges: DataFrame, zoom, on: tuple[str, ...], rng: str) -> DataFrame:
    """Placed footprints, once for each tile (``z, x, y``) of their closed tile range that lies in the range of their ``on``."""
    if on:
        within = placed.join(ranges.select(*on, F.col(rng).alias("__r")), list(on))
    else:
        # Behind ``inline`` the range is one subquery; as a plain column each use of it would be a copy with a plan of its own.
        within = placed.select("*", F.inline(F.array(F.struct(ranges.select(rng).scalar().alias("__r")))))
    clipped = within.withColumns(
        {
            "__x0": F.expr("greatest(__x0, CAST(__r.x_min AS BIGINT))"), "__x1": F.expr("least(__x1, CAST(__r.x_max AS BIGINT))"),
            "__y0": F.expr("greatest(__y0, CAST(__r.y_min AS BIGINT))"), "__y1": F.expr("least(__y1, CAST(__r.y_max AS BIGINT))"),
        }
    ).where("__r IS NOT NULL AND __x0 <= __x1 AND __y0 <= __y1")

    # Rows of footprints are small beside the tiles they open, and one may lie over very many: blocks of it, dealt to several tasks.
    n = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = (
        clipped.drop("__r", "__shift")
        .select("*", F.expr(f"explode(sequence(__x0, __x1, {RUN}L)) AS __bx"))
        .select("*", F.expr(f"explode(sequence(__y0, __y1, {RUN}L)) AS __by"))
        .repartition(n)
    )
    return (
        cut.select("*", F.expr(f"explode(sequence(__bx, least(__x1, __bx + {RUN - 1}))) AS __x"))
        .select("*", F.expr(f"explode(sequence(__by, least(__y1, __by + {RUN - 1}))) AS __y"))
        .select("*", T.col(zoom).cast("int").alias("z"), F.col("__x").cast("int").alias("x"), F.col("__y").cast("int").alias("y"))
        .drop("__x", "__y", "__bx", "__by", "__x0", "__x1", "__y0", "__y1")
    )


def with_empty_tiles(hits: DataFrame, ranges: DataFrame, zoom, on: tuple[str, ...] = (), rng: str = "range", **empty: str) -> DataFrame:
    """All tiles of the ranges: rows of ``hits`` (``on, z, x, y`` and the columns of ``empty``), and the SQL values of ``empty`` for the others.

    Only hits and runs of ``RUN`` tiles are shuffled. A run's hits, at most ``RUN``, meet it as one list, and the run is opened
    behind the join: a tile without a hit is never a row of a shuffle.
    """
    n = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    runs = (
        ranges.select(*on, *[F.col(rng)[f].alias(f"__{f}") for f in ("x_min", "x_max", "y_min", "y_max")])
        .select("*", F.expr(f"explode(sequence(__x_min, __x_max, {RUN})) AS __bx"))
        .select("*", F.expr(f"explode(sequence(shiftright(__y_min, {RUN_BITS}), shiftright(__y_max, {RUN_BITS}))) AS __run"))
        .select(
            *on, "__bx", "__run", F.expr(f"least(__bx + {RUN - 1}, __x_max)").alias("__last"),
            F.expr(f"greatest(__run * {RUN}, __y_min)").alias("__from"), F.expr(f"least(__run * {RUN} + {RUN - 1}, __y_max)").alias("__to"),
        )
        .repartition(n, *on, "__bx", "__run")
        .select(*on, "__run", "__from", "__to", F.expr("explode(sequence(__bx, __last)) AS x"))
    )
    columns = list(empty)
    keys = [*on, "x", "__run"]
    lists = hits.withColumn("__run", F.expr(f"shiftright(y, {RUN_BITS})")).groupBy(*keys).agg(F.collect_list(F.struct("y", *columns)).alias("__hits"))
    missing = "IF(__hits IS NULL, sequence(__from, __to), array_except(sequence(__from, __to), transform(__hits, h -> h.y)))"
    blank = f"named_struct('y', y, {', '.join(f"'{c}', {v}" for c, v in empty.items())})"
    blanks = f"transform({missing}, y -> {blank})"
    return (
        runs.hint("merge").join(lists, keys, "left")
        .select(*on, "x", F.expr(f"inline(IF(__hits IS NULL, {blanks}, concat(__hits, {blanks})))"))
        .select(*on, T.col(zoom).cast("int").alias("z"), "x", "y", *columns)
    )


def _keys(on: tuple[str, ...]) -> list[str]:
    return [*on, "z", "x", "y"]


def _count_hits(tiles: DataFrame | None, pairs: DataFrame, inside: Column, on, member: Column | None = None) -> DataFrame:
    """Hits per tile, zero where there is none; with ``member`` also ``members``, at most five of its hits' values.

    The tiles themselves enter the aggregation with weight 0, which replaces an outer join; without ``tiles`` only those with
    hits are counted. Counts are combined and member
    lists cut before the shuffle, so a tile under very many footprints costs one row per task. Five members are one more
    than a tile of unknown class can have, so the list of such a tile is whole. The smallest members are kept, in order:
    the same ones on every layout.
    """
    one = pairs.select(
        *_keys(on), F.lit(1).cast("bigint").alias("n"), inside.alias("inside"), *([] if member is None else [member.alias("member")])
    )
    kept = []
    if tiles is not None:
        zero = tiles.select(*_keys(on), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("inside"))
        if member is not None:
            zero = zero.withColumn("member", F.lit(None).cast(one.schema["member"].dataType))
        one = zero.union(one)
    if member is not None:
        kept = [InternalFunction.collect_top_k(F.col("member"), MAX_READABLE_HITS + 1, True).alias("members")]
    return (
        one.groupBy(*_keys(on))
        .agg(F.sum("n").alias("cog_count"), F.bool_or("inside").alias("inside_one"), *kept)
    )


def _inside(box: str, ring) -> Column:
    if ring is None:
        return G.bbox_contains(box, "tile_bbox")
    # The box test rejects rings without area, whose half-planes exclude nothing.
    return G.bbox_contains(box, "tile_bbox") & G.box_within_planes("tile_bbox", "__planes")


def tile_hits(
    tiles: DataFrame, footprints: DataFrame, zoom, box: str = "bbox", on=(), ring=None, max_shift=None
) -> DataFrame:
    """Number of footprints per tile and whether one of them contains it; tiles without hits give 0/false."""
    pairs = tile_footprint_join(tiles.select(*_keys(on)), footprints, zoom, box, on, ring, max_shift)
    return _count_hits(tiles, pairs, _inside(box, ring), on)


def undecided(hits: DataFrame) -> DataFrame:
    """Tiles whose class depends on their coverage: one to four hits, none of which contains the tile."""
    return hits.where(_is_undecided())


def _is_undecided() -> Column:
    return F.col("cog_count").between(1, MAX_READABLE_HITS) & ~F.col("inside_one")


def _unit_box(box: str, tile: str) -> Column:
    """The part of a box inside a tile, in units of that tile (0..1 on both axes)."""
    width, height = f"({tile}.xmax - {tile}.xmin)", f"({tile}.ymax - {tile}.ymin)"
    return F.expr(
        f"named_struct('xmin', greatest(({box}.xmin - {tile}.xmin) / {width}, 0D), "
        f"'ymin', greatest(({box}.ymin - {tile}.ymin) / {height}, 0D), "
        f"'xmax', least(({box}.xmax - {tile}.xmin) / {width}, 1D), "
        f"'ymax', least(({box}.ymax - {tile}.ymin) / {height}, 1D))"
    )


def _union_of_unit_boxes(boxes: str) -> Column:
    """Area of the union of at most four boxes by inclusion-exclusion, as plain arithmetic."""
    members = [f"get({boxes}, {i})" for i in range(MAX_READABLE_HITS)]
    terms = []
    for size in range(1, MAX_READABLE_HITS + 1):
        for chosen in combinations(members, size):
            # ``least`` and ``greatest`` want two arguments; repeating a member changes nothing.
            both = (*chosen, chosen[-1])
            low = {f: f"greatest({', '.join(f'{m}.{f}' for m in both)})" for f in ("xmin", "ymin")}
            high = {f: f"least({', '.join(f'{m}.{f}' for m in both)})" for f in ("xmax", "ymax")}
            area = f"greatest({high['xmax']} - {low['xmin']}, 0D) * greatest({high['ymax']} - {low['ymin']}, 0D)"
            # The members are filled from the front, so the last one tells whether all are there.
            terms.append(f"CASE WHEN {chosen[-1]} IS NULL THEN 0D ELSE {'' if size % 2 else '-'}({area}) END")
    return F.expr(" + ".join(terms))


def tile_summary(
    tiles: DataFrame, footprints: DataFrame, zoom, box: str = "bbox", on=(), ring=None, max_shift=None
) -> DataFrame:
    """``cog_count``, ``inside_one`` and ``coverage`` of every tile, from one join and one aggregation.

    ``coverage`` is null for tiles whose class does not depend on it.
    """
    tiles = tiles.select(*_keys(on))
    pairs = tile_footprint_join(tiles, footprints, zoom, box, on, ring, max_shift)
    return _with_coverage(_count_hits(tiles, pairs, _inside(box, ring), on, _member(box, ring)), on, ring)


def _member(box: str, ring: str | None) -> Column:
    if ring is None:
        return _unit_box(box, "tile_bbox")
    return G.ring_numbers(ring, "tile_bbox.xmin", "tile_bbox.ymin")  # near the origin doubles are precise


def _with_coverage(hits: DataFrame, on: tuple[str, ...], ring: str | None) -> DataFrame:
    # lists of decided tiles go no further
    opened = hits.withColumn("members", F.when(_is_undecided(), F.col("members")))
    if ring is None:
        share = F.when(F.col("members").isNotNull(), _union_of_unit_boxes("members"))
    else:
        size = T.tile_size("z")
        square = F.array(F.lit(0.0), F.lit(0.0), size, F.lit(0.0), size, size, F.lit(0.0), size)
        share = P.quad_union_share(square, F.flatten("members"))
    return opened.select(*_keys(on), "cog_count", "inside_one", share.alias("coverage"))


def range_summary(ranges: DataFrame, footprints: DataFrame, zoom, box: str = "bbox", on=(), ring=None, rng: str = "range") -> DataFrame:
    """``tile_summary`` of all tiles of the ranges.

    Counts are plain sums. The members come from a second pass over the pairs, ranked by value, which Spark limits to four a
    tile and task before the shuffle; both are partitioned by tile and join where they are. The join is a stated merge: the
    planner takes the tiles that footprints open for as small as the footprints and would broadcast the lists.
    """
    pairs = range_footprint_join(ranges, footprints, zoom, box, on, ring, rng)
    inside = _inside(box, ring)
    keys = _keys(on)
    first = Window.partitionBy(*keys).orderBy("member")
    lists = (
        pairs.where(~inside).select(*keys, _member(box, ring).alias("member"))
        .withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= MAX_READABLE_HITS)
        .groupBy(*keys).agg(F.array_sort(F.collect_list("member")).alias("members"))
    )
    hits = _count_hits(None, pairs, inside, on).hint("merge").join(lists, keys, "left")
    return with_empty_tiles(_with_coverage(hits, on, ring), ranges, zoom, on, rng, **NO_HITS)


def tile_coverage(
    tiles: DataFrame, footprints: DataFrame, zoom, box: str = "bbox", on=(), ring=None, max_shift=None
) -> DataFrame:
    """``coverage`` of each undecided tile."""
    summary = tile_summary(tiles, footprints, zoom, box, on, ring, max_shift)
    return undecided(summary).select(*_keys(on), "coverage")


def tile_class(cog_count="cog_count", inside_one="inside_one", coverage="coverage") -> Column:
    n = G.col(cog_count)
    return (
        F.when(n == 0, F.lit("empty"))
        .when(n > MAX_READABLE_HITS, F.lit("too_many"))
        .when(G.col(inside_one), F.lit("interior"))
        .when(G.col(coverage) >= COVERAGE_THRESHOLD, F.lit("seam"))
        .otherwise(F.lit("partial"))
    )


def classify_tiles(
    tiles: DataFrame, footprints: DataFrame, zoom, box: str = "bbox", on=(), ring=None, max_shift=None
) -> DataFrame:
    """``class`` and ``cog_count`` of every tile."""
    summary = tile_summary(tiles, footprints, zoom, box, on, ring, max_shift)
    return summary.select(*_keys(on), tile_class().alias("class"), "cog_count", "coverage")


def classify_range(ranges: DataFrame, footprints: DataFrame, zoom, box: str = "bbox", on=(), ring=None, rng: str = "range") -> DataFrame:
    """``classify_tiles`` of all tiles of the ranges."""
    summary = range_summary(ranges, footprints, zoom, box, on, ring, rng)
    return summary.select(*_keys(on), tile_class().alias("class"), "cog_count", "coverage")


def class_stats(classified: DataFrame, *by: str) -> DataFrame:
    """One row (per ``by``) with the number of tiles in each of the five classes and the tile range."""
    return classified.groupBy(*by).agg(
        *[F.count_if(F.col("class") == c).alias(c) for c in TILE_CLASSES],
        F.count(F.lit(1)).alias("tiles"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
    )


def usable_tiles(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("class").isin("interior", "seam"))


# --- native-CRS classification ----------------------------------------------------------------


def classify_tiles_native(
    tiles: DataFrame, footprints: DataFrame, zoom, native_box: str, web_box: str, crs: str, on=()
) -> DataFrame:
    """Classes computed in the footprints' own CRS: the tile is reprojected, the footprint stays a box.

    ``footprints`` must be in the one system that ``crs`` describes (see ``crs.crs_literal``). Candidate
    pairs still come from the 3857 grid, with the web box grown by a tile so that the curvature of edges
    between corners cannot hide a pair; the exact test then runs on the reprojected tile.
    """
    grown = _grown(footprints, zoom, native_box, web_box, on)
    pairs = tile_footprint_join(_with_native_tile(tiles.select(*_keys(on)), crs), grown, zoom, "__search", on)
    summary = _native_summary(tiles, pairs, on)
    return summary.select(*_keys(on), tile_class().alias("class"), "cog_count", "coverage")


def classify_range_native(
    ranges: DataFrame, footprints: DataFrame, zoom, native_box: str, web_box: str, crs: str, on=(), rng: str = "range"
) -> DataFrame:
    """``classify_tiles_native`` of all tiles of the ranges.

    Only tiles near a footprint are reprojected, each once, where the pairs of its key meet it: the reprojected tiles, far larger
    than their keys, are not shuffled, and the other tiles are empty.
    """
    grown = _grown(footprints, zoom, native_box, web_box, on)
    keys = _keys(on)
    places = [*on, "x", "y"]  # without the zoom, a constant: the planner would drop it on one side and shuffle that side again
    # A stated number, as a tile is a few bytes but costs about 0.1 ms to reproject.
    n = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    candidates = range_footprint_join(ranges, grown, zoom, "__search", on, rng=rng).select(*places, "__native")
    tiles = candidates.select(*places).distinct().repartition(n, *places).withColumn("z", T.col(zoom).cast("int"))
    pairs = candidates.hint("merge").join(_with_native_tile(tiles, crs), places)
    hits = with_empty_tiles(_native_summary(None, pairs, on), ranges, zoom, on, rng, **NO_HITS)
    return hits.select(*keys, tile_class().alias("class"), "cog_count", "coverage")


def _grown(footprints: DataFrame, zoom, native_box: str, web_box: str, on: tuple[str, ...]) -> DataFrame:
    size = T.tile_size(zoom)
    w = F.col(web_box)
    return footprints.select(
        *on,
        F.col(native_box).alias("__native"),
        G.bbox(w["xmin"] - size, w["ymin"] - size, w["xmax"] + size, w["ymax"] + size).alias("__search"),
    )


def _with_native_tile(tiles: DataFrame, crs: str) -> DataFrame:
    # ``inline`` evaluates its argument once per tile and keeps later pushdown from repeating it.
    boxed = tiles.withColumn("__tile_box", T.tile_bbox("x", "y", "z"))
    ringed = boxed.withColumn("__web", G.ring_from_bbox("__tile_box")).drop("__tile_box")
    moved = F.struct(C.reproject_ring("__web", C.crs_literal(3857), crs).alias("__ring"))
    shaped = F.struct(G.ring_bbox("__ring").alias("__box"), G.half_planes("__ring").alias("__tile_planes"))
    return ringed.select("*", F.inline(F.array(moved))).select("*", F.inline(F.array(shaped))).drop("__web")


def _native_summary(tiles: DataFrame | None, pairs: DataFrame, on: tuple[str, ...]) -> DataFrame:
    exact = pairs.where(
        G.bbox_intersects("__native", "__box") & ~G.box_misses_planes("__native", "__tile_planes")
    ).withColumn("__native_ring", G.ring_from_bbox("__native"))
    near = G.ring_numbers("__native_ring", "__box.xmin", "__box.ymin")
    target = G.ring_numbers("__ring", "__box.xmin", "__box.ymin")
    member = F.struct(near.alias("quad"), target.alias("target"))
    hits = _count_hits(tiles, exact, G.bbox_contains("__native", "__box"), on, member)
    opened = hits.withColumn("members", F.when(_is_undecided(), F.col("members")))
    quads = F.flatten(F.transform("members", lambda m: m["quad"]))
    share = P.quad_union_share(F.get("members", F.lit(0))["target"], quads)
    return opened.select(*_keys(on), "cog_count", "inside_one", share.alias("coverage"))


# --- read plan and window query ---------------------------------------------------------------


def tile_read_plan(
    tiles: DataFrame, footprints: DataFrame, zoom, box: str = "bbox", on=(), ring=None, max_shift=None
) -> DataFrame:
    """One row per tile and file to read (``key, location, tile_srs``).

    Kept flat: a tile under a huge number of footprints stays many rows instead of one giant array.
    Readers order by tile and key; a range-partitioned sort on those columns does so without gathering.
    """
    pairs = tile_footprint_join(tiles.select(*_keys(on)), footprints, zoom, box, on, ring, max_shift)
    return pairs.select(*_keys(on), "key", "location", "tile_srs")


def nested_read_plan(plan: DataFrame, classified: DataFrame, on=()) -> DataFrame:
    """Ordered ``files`` array per usable tile; those have at most four files by definition."""
    wanted = usable_tiles(classified).select(*_keys(on))
    return (
        plan.join(wanted, _keys(on), "left_semi")
        .groupBy(*_keys(on))
        .agg(F.array_sort(F.collect_list(F.struct("key", "location", "tile_srs"))).alias("files"))
    )


def bbox_window(
    footprints: DataFrame, window: tuple[float, float, float, float], box: str = "bbox", ring: str | None = None,
    max_rows: int | None = None, order: str | None = None,
) -> DataFrame:
    """Footprints that intersect a window given as (xmin, ymin, xmax, ymax).

    The four comparisons are on struct fields against constants and reach the Parquet row groups.
    ``max_rows`` is the feature cap that a request states; it needs ``order``, so that the cap is a top-k.
    """
    if max_rows is not None and order is None:
        raise ValueError("a feature cap needs an order")
    xmin, ymin, xmax, ymax = (float(v) for v in window)
    b = F.col(box)
    found = footprints.where(
        (b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin)
    )
    if ring is not None:
        kept = found.columns
        shaped = found.withColumns({"__window": G.bbox(xmin, ymin, xmax, ymax), "__planes": G.half_planes(ring)})
        found = shaped.where(~G.box_misses_planes("__window", "__planes")).select(*kept)
    if order is not None:
        found = found.orderBy(order)
    return found if max_rows is None else found.limit(max_rows)


def wfs_window(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> tuple[float, float, float, float]:
    """A lat/lon ordered request box as x, y order."""
    return (min_lon, min_lat, max_lon, max_lat)


def label_points(found: DataFrame, box: str = "bbox", max_features: int = 500) -> DataFrame:
    """Label position at each box centre, only when the whole result has at most ``max_features`` rows."""
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    b = F.col(box)
    name = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.element_at(F.split("location", "/"), -1))
    return (
        found.where(total <= max_features)
        .select(
            "key",
            name.alias("label"),
            ((b["xmin"] + b["xmax"]) / 2.0).alias("label_x"),
            ((b["ymin"] + b["ymax"]) / 2.0).alias("label_y"),
        )
        .where(F.coalesce(F.col("label"), F.lit("")) != "")
    )
