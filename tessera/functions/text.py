"""Strings, dates and defensive conversions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import col

# Formats that other programs rely on.
S3_URI = r"^s3://([^/]+)/(.+)$"
#: A quoted text, a name with its opening bracket, or a closing bracket of WKT.
WKT_TOKEN = r'"[^"]*"|[A-Za-z_0-9]+\s*[\[(]|[\])]'
COLLECTION_ID = r"^[a-z0-9]+(-[a-z0-9]+)*$"
STATE_CODE = r"^[a-z]{2}$"
RASTER_SUFFIX = r"\.tiff?$"
DISCOVERED_LINE = r"Discovered (\d+) GeoTIFFs"
PROGRESS_LINE = r"Scanned (\d+)/(\d+); failures=(\d+)"
REQUIRED_SCAN_FIELDS = ("bucket", "collection_id", "prefix")
DEFAULT_PROCESSING = ("BANDS=1,2,3", "RESAMPLE=AVERAGE")


def extract(value, pattern: str, group: int) -> Column:
    """Regex group or null when the pattern does not match."""
    return F.nullif(F.regexp_extract(col(value), pattern, group), F.lit(""))


def split_s3_uri(uri) -> Column:
    """``struct<bucket,key>``; a malformed address raises when the row is evaluated."""
    u = col(uri)
    parts = F.struct(extract(u, S3_URI, 1).alias("bucket"), extract(u, S3_URI, 2).alias("key"))
    error = F.raise_error(F.concat(F.lit("invalid S3 URI: "), F.coalesce(u, F.lit("null"))))
    return F.when(u.rlike(S3_URI), parts).otherwise(error.cast("struct<bucket:string,key:string>"))


def try_split_s3_uri(uri) -> Column:
    u = col(uri)
    return F.when(
        u.rlike(S3_URI), F.struct(extract(u, S3_URI, 1).alias("bucket"), extract(u, S3_URI, 2).alias("key"))
    )


def normalize_bucket(bucket) -> Column:
    return F.btrim(F.regexp_replace(col(bucket), "^s3://", ""), F.lit("/"))


def normalize_prefix(prefix) -> Column:
    """No scheme, no outer slashes, one trailing slash unless empty."""
    bare = F.btrim(F.regexp_replace(col(prefix), "^s3://", ""), F.lit("/"))
    return F.when(bare == "", bare).otherwise(F.concat(bare, F.lit("/")))


def epsg_from_wkt(wkt, override=None) -> Column:
    """EPSG code of the system that a WKT text describes: that of its root, else that of the projected system in it.

    The tokens are read once with the names of the open brackets, so a code counts only for the bracket that it stands in:
    those of datums, units and of a vertical or geographic part never do, whatever the nesting.
    """
    tokens = F.regexp_extract_all(col(wkt), F.lit(WKT_TOKEN), F.lit(0))
    empty = F.struct(F.array().cast("array<string>").alias("path"), F.lit("").alias("name"), F.lit(None).cast("int").alias("root"), F.lit(None).cast("int").alias("projected"))

    def read(s: Column, t: Column) -> Column:
        def state(path=s["path"], name=s["name"], root=s["root"], projected=s["projected"]):
            return F.struct(path.alias("path"), name.alias("name"), root.alias("root"), projected.alias("projected"))

        depth = F.size(s["path"])
        number = F.btrim(t, F.lit('"')).try_cast("int")
        opened = F.concat(s["path"], F.array(F.upper(F.btrim(t, F.lit("[( ")))))
        inside = F.get(s["path"], depth - 1) == "AUTHORITY"
        is_code = inside & (s["name"] == "EPSG")
        return (
            F.when(t.rlike(r"[\[(]$"), state(path=opened, name=F.lit("")))
            .when(t.rlike(r"^[\])]$"), state(path=F.slice(s["path"], 1, F.greatest(depth - 1, F.lit(0))), name=F.lit("")))
            .when(depth < 2, s)
            .when(inside & (s["name"] == ""), state(name=F.upper(F.btrim(t, F.lit('"')))))
            .when(is_code & (depth == 2), state(root=F.coalesce(s["root"], number)))
            .when(is_code & (depth == 3) & (F.get(s["path"], F.lit(1)) == "PROJCS"), state(projected=F.coalesce(s["projected"], number)))
            .otherwise(s)
        )

    found = F.aggregate(tokens, empty, read, lambda s: F.coalesce(s["root"], s["projected"]))
    return found if override is None else F.coalesce(found, F.nullif(col(override).cast("int"), F.lit(0)))


def location_url(base, mode, region, bucket, key) -> Column:
    """Address a raster is read through, as written by a scan; null where a part is missing."""
    parts = (F.rtrim(col(base), F.lit("/")), col(mode), col(region), col(bucket), F.ltrim(col(key), F.lit("/")))
    return F.concat(F.lit("/vsicurl"), *(x for p in parts for x in (F.lit("/"), p)))


def staged_location(base, mode, region, bucket, key) -> Column:
    """Address as written by staging: same parts, no ``/vsicurl`` and the key untouched."""
    first, *rest = (F.rtrim(col(base), F.lit("/")), col(mode), col(region), col(bucket), col(key))
    return F.concat(first, *(x for p in rest for x in (F.lit("/"), p)))


def payer_mode(requester_pays) -> Column:
    return F.when(col(requester_pays), F.lit("requester-pays")).otherwise(F.lit("standard"))


def tile_srs(epsg) -> Column:
    return F.concat(F.lit("EPSG:"), col(epsg).cast("int").cast("string"))


def file_name(key) -> Column:
    return F.element_at(F.split(col(key), "/"), -1)


def file_stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_raster_key(key) -> Column:
    return F.lower(col(key)).rlike(RASTER_SUFFIX)


def slugify(value) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(value)), "[^a-z0-9-]+", "-"), F.lit("-"))


def is_collection_id(value) -> Column:
    return F.coalesce(col(value).rlike(COLLECTION_ID), F.lit(False))


def missing_fields(given, required=REQUIRED_SCAN_FIELDS) -> Column:
    """Sorted names in ``required`` that are not in the array ``given``."""
    return F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), col(given)))


def age_text(iso_text, now) -> Column:
    """``12s ago`` / ``5m ago`` / ``3h ago`` / ``2d ago``; empty when the text is not a timestamp."""
    then = F.try_to_timestamp(col(iso_text))
    age = F.floor(F.unix_micros(col(now)) / F.lit(1_000_000) - F.unix_micros(then) / F.lit(1_000_000)).cast("bigint")

    def unit(divisor: int, letter: str) -> Column:
        return F.concat(F.expr("0L") + F.floor(age / divisor).cast("bigint"), F.lit(letter + " ago"))

    return (
        F.when(age.isNull(), F.lit(""))
        .when(age < 60, unit(1, "s"))
        .when(age < 3600, unit(60, "m"))
        .when(age < 86400, unit(3600, "h"))
        .otherwise(unit(86400, "d"))
    )


def status_text(cog_count, indexed_at, postgis, parquet, now) -> Column:
    """``9,202 COGs · indexed 2h ago · postgis``; ``configured`` when nothing is known."""
    stamp = col(indexed_at)
    age = age_text(stamp, now)
    shown = F.when(F.coalesce(stamp, F.lit("")) != "", F.concat(F.lit("indexed "), F.when(age == "", stamp).otherwise(age)))
    backend = F.when(F.coalesce(col(postgis), F.lit(False)), F.lit("postgis")).when(
        F.coalesce(col(parquet), F.lit(False)), F.lit("geoparquet")
    )
    text = F.concat_ws(" · ", F.concat(F.format_number(col(cog_count), 0), F.lit(" COGs")), shown, backend)
    return F.when(text == "", F.lit("configured")).otherwise(text)


def layer_name(base, epsg, group_count) -> Column:
    """The base name, with the code appended only when a collection has several groups."""
    b = col(base)
    return F.when(col(group_count) > 1, F.concat(b, F.lit("-"), col(epsg).cast("string"))).otherwise(b)


def index_layer_name(collection_id, epsg) -> Column:
    return F.concat(col(collection_id), F.lit("_tileindex_"), col(epsg).cast("string"))


def default_processing(processing) -> Column:
    given = F.nullif(col(processing), F.array().cast("array<string>"))
    return F.coalesce(given, F.array(*[F.lit(p) for p in DEFAULT_PROCESSING]))


def safe_double(text) -> Column:
    """Number from text; 0.0 for anything that is not one."""
    return F.coalesce(col(text).try_cast("double"), F.lit(0.0))


def safe_int(text) -> Column:
    return F.coalesce(col(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def latency_text(seconds) -> Column:
    """``512 ms`` below one second, else ``1.25 s``; a dash for null."""
    s = col(seconds)
    millis = F.format_string("%.0f ms", s * 1000.0)
    return F.when(s.isNull(), F.lit("—")).when(s < 1, millis).otherwise(F.format_string("%.2f s", s))


def tile_time_text(milliseconds) -> Column:
    """Label of one loaded tile, from milliseconds."""
    ms = col(milliseconds)
    whole = F.floor(ms + 0.5).cast("string")
    return F.when(ms >= 1000, F.format_string("%.2f s", ms / 1000.0)).otherwise(F.concat(whole, F.lit(" ms")))


def latency_class(seconds) -> Column:
    s = col(seconds)
    return F.when(s > 2, F.lit("slow")).when(s < 0.5, F.lit("ok")).otherwise(F.lit(""))
