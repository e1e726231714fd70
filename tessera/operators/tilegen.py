"""Tile ranges, grids and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tiles as T
from ..functions.geometry import col
from ..session import materialize
from . import spatial

# The area and centre used when a collection states no bounds ([[lat, lon], [lat, lon]]).
FALLBACK_BOUNDS = ((37.0, -90.0), (42.0, -73.0))
FALLBACK_CENTER = (39.5, -82.0)


def tile_range(bounds, zoom) -> Column:
    """Inclusive tile range of ``[[lat, lon], [lat, lon]]``, corners in any order."""
    b = col(bounds)
    lat = (F.least(b[0][0], b[1][0]), F.greatest(b[0][0], b[1][0]))
    lon = (F.least(b[0][1], b[1][1]), F.greatest(b[0][1], b[1][1]))
    xs = [T.lonlat_to_tile_x(v, zoom) for v in lon]
    ys = [T.lonlat_to_tile_y(v, zoom) for v in lat]
    return F.struct(
        F.least(*xs).alias("x_min"), F.greatest(*xs).alias("x_max"),
        F.least(*ys).alias("y_min"), F.greatest(*ys).alias("y_max"),
    )


def fallback_bounds() -> Column:
    return F.array(*[F.array(*[F.lit(v) for v in pair]) for pair in FALLBACK_BOUNDS])


# One generated row stands for a block of this many tiles per axis; blocks are spread over the
# cluster before they are opened, so a single huge range does not stay in one task.
BLOCK = 256


def tile_grid(ranges: DataFrame, zoom, on: tuple[str, ...] = (), rng: str = "range") -> DataFrame:
    """All tiles of each row's range; ``on`` columns are carried along."""
    r = F.col(rng)
    # a stated number, as block rows are tiny and adaptive coalescing would put them all into one task
    n = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = (
        ranges.select(*on, T.col(zoom).cast("int").alias("z"), r.alias("__r"))
        .select("*", F.explode(F.sequence(F.col("__r")["x_min"], F.col("__r")["x_max"], F.lit(BLOCK))).alias("__bx"))
        .select("*", F.explode(F.sequence(F.col("__r")["y_min"], F.col("__r")["y_max"], F.lit(BLOCK))).alias("__by"))
        .repartition(n, *on, "__bx", "__by")
    )

    def opened(start: str, last: str) -> Column:
        return F.explode(F.sequence(F.col(start), F.least(F.col(start) + BLOCK - 1, F.col("__r")[last])))

    return (
        blocks.select("*", opened("__bx", "x_max").alias("x"))
        .select("*", opened("__by", "y_max").alias("y"))
        .select(*on, "z", "x", "y")
    )


def tiles_of_collection(collections: DataFrame, zoom="native_zoom", rng: str = "range") -> DataFrame:
    """Tiles over each collection's bounds (``id, bounds``), at its own zoom."""
    ranged = collections.withColumn(rng, tile_range(F.coalesce("bounds", fallback_bounds()), zoom))
    return tile_grid(ranged.withColumnRenamed("id", "collection_id"), zoom, ("collection_id",), rng)


def distinct_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.dropDuplicates(["z", "x", "y"])


def max_attempts(requests: int, factor: int = 200) -> int:
    return max(requests * factor, requests + 1000)


def _uniform(low: Column, high: Column, seed: int, salt: str) -> Column:
    """Integer in ``low..high`` from a hash of the attempt number: the same on every retry and layout."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col("attempt").cast("string")))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
    return (low + draw % (high - low + 1)).cast("int")


def draw_tiles(ranges: DataFrame, zoom: int, attempts: int, seed: int, rng: str = "range", after: int = 0) -> DataFrame:
    """Random tiles of a one-row range for the attempts ``after + 1 .. attempts``; repeats included.

    The attempts are generated in parallel, and the range comes to them as one value.
    """
    drawn = ranges.sparkSession.range(after + 1, attempts + 1)
    return (
        drawn.select(ranges.select(rng).scalar().alias("__r"), F.col("id").cast("int").alias("attempt"))
        .select(
            "attempt",
            F.lit(zoom).cast("int").alias("z"),
            _uniform(F.col("__r")["x_min"], F.col("__r")["x_max"], seed, "x").alias("x"),
            _uniform(F.col("__r")["y_min"], F.col("__r")["y_max"], seed, "y").alias("y"),
        )
    )


def first_attempts(drawn: DataFrame) -> DataFrame:
    """Each distinct tile with the attempt that drew it first."""
    return drawn.groupBy("z", "x", "y").agg(F.min("attempt").alias("attempt"))


def classify_draws(
    ranges: DataFrame, footprints: DataFrame, zoom: int, requests: int, seed: int = 0, box: str = "bbox",
    rng: str = "range", ring: str | None = None,
) -> DataFrame:
    """Every distinct drawn tile with its attempt number and class."""
    attempts = max_attempts(requests)
    drawn = first_attempts(draw_tiles(ranges, zoom, attempts, seed, rng))
    classes = spatial.classify_tiles(drawn, footprints, zoom, box, (), ring)
    return drawn.join(classes, ["z", "x", "y"])


def classify_in_rounds(
    ranges: DataFrame, footprints: DataFrame, zoom: int, requests: int, seed: int = 0, box: str = "bbox",
    rng: str = "range", ring: str | None = None, first: int | None = None,
) -> DataFrame:
    """The draws of ``classify_draws`` up to the round in which ``requests`` of them are usable.

    Each round has four times as many attempts as there were so far, and only tiles not drawn before are classified. The
    rounds' results are kept in the shared folder. Draws depend on the attempt's number alone, so the first usable ones are
    those that classifying every attempt gives.
    """
    limit = max_attempts(requests)
    done, size, known = 0, first or 4 * requests, None
    while done < limit:
        upto = min(limit, done + size)
        drawn = first_attempts(draw_tiles(ranges, zoom, upto, seed, rng, after=done))
        fresh = drawn if known is None else drawn.join(known, ["z", "x", "y"], "left_anti")
        classes = spatial.classify_tiles(fresh, footprints, zoom, box, (), ring)
        part = materialize(fresh.join(classes, ["z", "x", "y"]), "draws")
        known = part if known is None else known.union(part)
        if spatial.usable_tiles(known).limit(requests).count() == requests:
            break
        done, size = upto, 4 * upto
    return known


def sample_tiles(classified_draws: DataFrame, requests: int) -> DataFrame:
    """The first ``requests`` usable tiles in drawing order."""
    return (
        spatial.usable_tiles(classified_draws)
        .orderBy("attempt")
        .limit(requests)
        .select("z", "x", "y", "class", "cog_count", "attempt")
    )


def sample_stats(classified_draws: DataFrame, requests: int, attempts: int | None = None) -> DataFrame:
    """Counts per class over all draws, repeats, and how many tiles a request for ``requests`` gets."""
    tried = max_attempts(requests) if attempts is None else attempts
    usable = F.count_if(F.col("class").isin("interior", "seam"))
    return classified_draws.agg(
        F.lit(tried).cast("bigint").alias("attempts"),
        F.lit(requests).cast("bigint").alias("requested"),
        F.least(usable, F.lit(requests).cast("bigint")).alias("generated"),
        *[F.count_if(F.col("class") == c).alias(c) for c in spatial.TILE_CLASSES],
        (F.lit(tried).cast("bigint") - F.count(F.lit(1))).alias("duplicates"),
    )


def require_tiles(sampled: DataFrame) -> DataFrame:
    """The sample itself; an error when it is empty. Runs one short job."""
    if sampled.isEmpty():
        raise RuntimeError("could not generate any valid benchmark tiles from the active collection")
    return sampled


def one_row_range(spark: SparkSession, bounds, zoom: int) -> DataFrame:
    """Range of literal bounds ``((lat, lon), (lat, lon))``."""
    arr = F.array(*[F.array(*[F.lit(float(v)) for v in pair]) for pair in bounds])
    return spark.range(1).select(tile_range(arr, zoom).alias("range"))
