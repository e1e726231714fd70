"""Boxes and rings as columns.

A box is ``struct<xmin,ymin,xmax,ymax: double>``; a ring is a closed ``array<struct<x,y: double>>``.
Axis order is always x, y. Boxes keep their fields addressable (``bbox.xmin``) so comparisons on them
reach the Parquet row groups.

Helpers on rings and pairs of boxes take column names (or any SQL text) and are built as SQL text: that is
one call into the JVM instead of hundreds, which is what planning time is made of.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BBOX_TYPE = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
RING_TYPE = "array<struct<x:double,y:double>>"
BBOX_FIELDS = ("xmin", "ymin", "xmax", "ymax")


def col(value) -> Column:
    """Column from a column, a column name or a literal number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def bbox(xmin, ymin, xmax, ymax) -> Column:
    parts = (xmin, ymin, xmax, ymax)
    if all(isinstance(v, (str, int, float)) for v in parts):
        text = ", ".join(f"'{n}', CAST({v} AS DOUBLE)" for n, v in zip(BBOX_FIELDS, parts))
        return F.expr(f"named_struct({text})")
    return F.struct(*(col(v).cast("double").alias(n) for n, v in zip(BBOX_FIELDS, parts)))


def bbox_array(box) -> Column:
    """``[xmin, ymin, xmax, ymax]``, null for a null box."""
    b = col(box)
    return F.when(b.isNotNull(), F.array(*(b[f] for f in BBOX_FIELDS)))


def bbox_from_array(arr) -> Column:
    a = col(arr)
    return F.when(F.size(a) == 4, bbox(a[0], a[1], a[2], a[3]))


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


# --- footprint construction -------------------------------------------------------------------


def footprint_bbox(gt, width, height) -> Column:
    """Axis-aligned box between the two corners a geotransform spans; skewed transforms included."""
    g = [col(gt)[i] for i in range(6)]
    w, h = col(width), col(height)
    far_x = g[0] + g[1] * w + g[2] * h
    far_y = g[3] + g[4] * w + g[5] * h
    return bbox(F.least(g[0], far_x), F.least(g[3], far_y), F.greatest(g[0], far_x), F.greatest(g[3], far_y))


def _point_text(x: str, y: str) -> str:
    return f"named_struct('x', {x}, 'y', {y})"


def _finite_text(v: str) -> str:
    return f"({v} IS NOT NULL AND NOT isnan({v}) AND abs({v}) < double('infinity'))"


def ring_from_bbox(box: str) -> Column:
    """Closed ring, counter-clockwise from the lower-left corner."""
    x0, y0, x1, y1 = (f"{box}.{f}" for f in BBOX_FIELDS)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.expr(f"array({', '.join(_point_text(x, y) for x, y in corners)})")


def ring_bbox(ring: str) -> Column:
    """Box around the points of a ring whose two coordinates are both finite; null if there is none."""
    xs, ys = "transform(good, p -> p.x)", "transform(good, p -> p.y)"
    around = (
        f"named_struct('xmin', array_min({xs}), 'ymin', array_min({ys}), 'xmax', array_max({xs}), 'ymax', array_max({ys}))"
    )
    good = f"filter({ring}, p -> {_finite_text('p.x')} AND {_finite_text('p.y')})"
    return F.expr(f"transform(array({good}), good -> CASE WHEN size(good) > 0 THEN {around} END)[0]")


def plain_number(value) -> Column:
    """Shortest decimal text without an exponent, for coordinates."""
    v = col(value)
    wide = F.rtrim(v.cast("decimal(38,9)").cast("string"), F.lit("0"))
    wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    return F.when(F.abs(v) >= 1e7, wide).otherwise(v.cast("string"))


def ring_to_wkt(ring) -> Column:
    points = F.transform(col(ring), lambda p: F.concat_ws(" ", plain_number(p["x"]), plain_number(p["y"])))
    return F.concat(F.lit("POLYGON(("), F.array_join(points, ", "), F.lit("))"))


def is_finite(value) -> Column:
    v = col(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def is_finite_ring(ring: str) -> Column:
    return F.expr(f"forall({ring}, p -> {_finite_text('p.x')} AND {_finite_text('p.y')})")


def keep_finite_ring(ring: str) -> Column:
    """The ring itself, or null when any coordinate is missing or not finite."""
    return F.expr(
        f"CASE WHEN forall({ring}, p -> {_finite_text('p.x')} AND {_finite_text('p.y')}) THEN {ring} END"
    )


def round_bbox(box, places: int) -> Column:
    """Half-even rounding of the four edges; null stays null.

    ``bround`` rounds the shortest decimal text of a double, so a value such as 2.675 (stored slightly
    below) becomes 2.68 here where binary rounding gives 2.67.
    """
    b = col(box)
    return F.when(b.isNotNull(), bbox(*(F.bround(b[f], places) for f in BBOX_FIELDS)))


def truncate_bbox(box) -> Column:
    """Edges cut toward zero, as whole-number doubles."""
    b = col(box)
    return F.when(b.isNotNull(), bbox(*(b[f].cast("bigint") for f in BBOX_FIELDS)))


def bounds_from_bbox(box, fallback=None) -> Column:
    """``[[minLat, minLon], [maxLat, maxLon]]`` for a lon/lat box."""
    b = col(box)
    pairs = F.when(b.isNotNull(), F.array(F.array(b["ymin"], b["xmin"]), F.array(b["ymax"], b["xmax"])))
    return pairs if fallback is None else F.coalesce(pairs, fallback)


def center_from_bbox(box, fallback=None) -> Column:
    """``[lat, lon]`` of the middle of a lon/lat box."""
    b = col(box)
    pair = F.when(
        b.isNotNull(), F.array((b["ymin"] + b["ymax"]) / 2.0, (b["xmin"] + b["xmax"]) / 2.0)
    )
    return pair if fallback is None else F.coalesce(pair, fallback)


# --- predicates -------------------------------------------------------------------------------


def bbox_intersects(a: str, b: str) -> Column:
    """True when the closed boxes share at least one point; touching edges count."""
    return F.expr(f"{a}.xmin <= {b}.xmax AND {a}.xmax >= {b}.xmin AND {a}.ymin <= {b}.ymax AND {a}.ymax >= {b}.ymin")


def bbox_contains(outer: str, inner: str) -> Column:
    o, i = outer, inner
    return F.expr(f"{o}.xmin <= {i}.xmin AND {o}.ymin <= {i}.ymin AND {o}.xmax >= {i}.xmax AND {o}.ymax >= {i}.ymax")


def _area_text(ring: str) -> str:
    """Signed shoelace area of a closed ring, relative to its first vertex to keep the digits."""
    pairs = f"zip_with(slice({ring}, 1, size({ring}) - 1), slice({ring}, 2, size({ring}) - 1), (p, q) -> " + (
        f"(p.x - {ring}[0].x) * (q.y - {ring}[0].y) - (q.x - {ring}[0].x) * (p.y - {ring}[0].y))"
    )
    return f"aggregate({pairs}, 0D, (total, t) -> total + t) / 2"


def ring_area(ring: str) -> Column:
    return F.expr(f"abs({_area_text(ring)})")


def _planes_text(ring: str) -> str:
    plane = (
        "named_struct('a', sign * (p.y - q.y), 'b', sign * (q.x - p.x), 'x', p.x, 'y', p.y)"
    )
    edges = f"zip_with(slice({ring}, 1, size({ring}) - 1), slice({ring}, 2, size({ring}) - 1), (p, q) -> {plane})"
    turn = f"CASE WHEN {_area_text(ring)} < 0 THEN -1D ELSE 1D END"
    return f"transform(array({turn}), sign -> {edges})[0]"


def half_planes(ring: str) -> Column:
    """A convex ring as the half-planes it is the intersection of.

    Each is ``struct<a,b,x,y>`` with ``a*(px-x) + b*(py-y) >= 0`` inside; the winding of the ring does not
    matter. Computed once per ring before a join, they make every later test plain arithmetic.
    """
    return F.expr(_planes_text(ring))


def box_misses_planes(box: str, planes: str) -> Column:
    """Some half-plane excludes all of the box. With overlapping bounding boxes this decides intersection."""
    far_x = f"(CASE WHEN e.a > 0 THEN {box}.xmax ELSE {box}.xmin END - e.x)"
    far_y = f"(CASE WHEN e.b > 0 THEN {box}.ymax ELSE {box}.ymin END - e.y)"
    return F.expr(f"exists({planes}, e -> e.a * {far_x} + e.b * {far_y} < 0)")


def box_within_planes(box: str, planes: str) -> Column:
    """The whole box lies in the closed convex ring; says nothing about a ring without area."""
    near_x = f"(CASE WHEN e.a > 0 THEN {box}.xmin ELSE {box}.xmax END - e.x)"
    near_y = f"(CASE WHEN e.b > 0 THEN {box}.ymin ELSE {box}.ymax END - e.y)"
    return F.expr(f"forall({planes}, e -> e.a * {near_x} + e.b * {near_y} >= 0)")


def ring_intersects(a: str, b: str) -> Column:
    """Closed intersection of two convex rings by the separating-axis test."""

    def separated(r: str, s: str) -> str:
        return f"exists({_planes_text(r)}, e -> forall({s}, v -> e.a * (v.x - e.x) + e.b * (v.y - e.y) < 0))"

    return F.expr(f"NOT {separated(a, b)} AND NOT {separated(b, a)}")


def ring_contains(outer: str, inner: str) -> Column:
    """All vertices of ``inner`` lie in the closed convex ring ``outer``."""
    return F.expr(
        f"forall({_planes_text(outer)}, e -> forall({inner}, v -> e.a * (v.x - e.x) + e.b * (v.y - e.y) >= 0))"
    )


def ring_numbers(ring: str, x0: str = "0D", y0: str = "0D") -> Column:
    """The four corners of a closed quadrilateral as eight numbers relative to (x0, y0)."""
    return F.expr(f"flatten(transform(slice({ring}, 1, 4), p -> array(p.x - {x0}, p.y - {y0})))")


# --- spatial order ----------------------------------------------------------------------------



def z_order(box: str, world: float = 20037508.342789244, bits: int = 24) -> Column:
    """Morton number of a box centre on a ``2^bits`` grid (at most 31 bits) over ``[-world, world]`` on both axes."""
    cells = 2**bits

    def grid(low: str, high: str) -> str:
        unit = f"(({box}.{low} + {box}.{high}) / 2D + {world!r}D) / {2.0 * world!r}D"
        return f"CAST(least(greatest(floor({unit} * {cells}), 0L), {cells - 1}L) AS BIGINT)"

    def spread(value: str) -> str:
        """A zero bit before each bit, in five halving steps."""
        for shift in (16, 8, 4, 2, 1):
            kept = sum(((1 << shift) - 1) << at for at in range(0, 64, 2 * shift))
            value = f"transform(array({value}), v -> (v | shiftleft(v, {shift})) & {kept}L)[0]"
        return value

    return F.expr(f"{spread(grid('xmin', 'xmax'))} | shiftleft({spread(grid('ymin', 'ymax'))}, 1)")
