"""Coordinate reference systems in closed form, as columns.

A small parameter table (one row per EPSG code, about two hundred rows by construction) is broadcast and
joined to the data; the formulas then run as column expressions, so each row may carry its own CRS.
Transverse Mercator uses the Krueger series to fourth order. Lambert conformal conics have one or two parallels; a polar
stereographic system is one whose cone is the plane (cone constant 1, or -1 in the south). Albers conics invert the authalic
latitude by its series and one Newton step. All are published, and the tests check them by round trips, published control
points and the points that define each system. NAD83 and WGS84 are taken as equal; NAD27 is shifted by the mean
geocentric translation of the contiguous United States. An unknown code yields null coordinates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import bbox, col, point
from .tiles import EARTH_RADIUS

# Ellipsoids and the foot of the US survey.
GRS80 = (6378137.0, 1.0 / 298.257222101)
WGS84 = (6378137.0, 1.0 / 298.257223563)
CLARKE_1866 = (6378206.4, (6378206.4 - 6356583.8) / 6378206.4)
NAD27_SHIFT = [-8.0, 160.0, 176.0]
US_FOOT = 1200.0 / 3937.0

CRS_SCHEMA = (
    "epsg int, method string, lon0 double, k0 double, fe double, fn double, unit double, a double, e double, "
    "alpha array<double>, beta array<double>, delta array<double>, scale double, offset double, cone double, "
    "area double, pole double, shift array<double>"
)


def _series(flattening: float):
    n = flattening / (2.0 - flattening)
    n2, n3, n4 = n * n, n**3, n**4
    alpha = [
        n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180,
        13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440,
        61 * n3 / 240 - 103 * n4 / 140,
        49561 * n4 / 161280,
    ]
    beta = [
        n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360,
        n2 / 48 + n3 / 15 - 437 * n4 / 1440,
        17 * n3 / 480 - 37 * n4 / 840,
        4397 * n4 / 161280,
    ]
    delta = [
        2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45,
        7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45,
        56 * n3 / 15 - 136 * n4 / 35,
        4279 * n4 / 630,
    ]
    radius_factor = (1 + n2 / 4 + n4 / 64) / (1 + n)
    return alpha, beta, delta, radius_factor


def _conformal_tan(lat: float, e: float) -> float:
    return math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat)))


def _transverse_mercator(epsg, lat0, lon0, k0, fe, fn, unit, ellipsoid, shift=None):
    a, f = ellipsoid
    e = math.sqrt(f * (2 - f))
    alpha, beta, delta, factor = _series(f)
    xi0 = math.atan(_conformal_tan(math.radians(lat0), e))
    xi0 += sum(c * math.sin(2 * (j + 1) * xi0) for j, c in enumerate(alpha))
    return (epsg, "tm", math.radians(lon0), k0, fe, fn, unit, a, e, alpha, beta, delta, k0 * a * factor, xi0, None, None, None, shift)


def _m(phi: float, e: float) -> float:
    """Radius of a parallel on the ellipsoid, in units of the major axis."""
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _t(phi: float, e: float) -> float:
    return math.exp(-math.asinh(_conformal_tan(phi, e)))


def _conic(epsg, lon0, fe, fn, unit, ellipsoid, scale, offset, cone):
    a, f = ellipsoid
    _, _, delta, _ = _series(f)
    e = math.sqrt(f * (2 - f))
    return (epsg, "lcc", math.radians(lon0), 1.0, fe, fn, unit, a, e, None, None, delta, scale, offset, cone, None, None, None)


def _lambert(epsg, lat0, lon0, lat1, lat2, fe, fn, unit, ellipsoid):
    a, f = ellipsoid
    e = math.sqrt(f * (2 - f))
    phi0, phi1, phi2 = (math.radians(v) for v in (lat0, lat1, lat2))
    cone = (math.log(_m(phi1, e)) - math.log(_m(phi2, e))) / (math.log(_t(phi1, e)) - math.log(_t(phi2, e)))
    scale = a * _m(phi1, e) / (cone * _t(phi1, e) ** cone)
    return _conic(epsg, lon0, fe, fn, unit, ellipsoid, scale, scale * _t(phi0, e) ** cone, cone)


def _lambert_one(epsg, lat0, lon0, k0, fe, fn, unit, ellipsoid):
    """Lambert conformal conic with one standard parallel and a scale on it."""
    a, f = ellipsoid
    e, phi0 = math.sqrt(f * (2 - f)), math.radians(lat0)
    cone = math.sin(phi0)
    scale = a * k0 * _m(phi0, e) / (cone * _t(phi0, e) ** cone)
    return _conic(epsg, lon0, fe, fn, unit, ellipsoid, scale, scale * _t(phi0, e) ** cone, cone)


def _polar(epsg, lon0, fe, fn, ellipsoid, true_lat=None, k0=None, south=False):
    """Polar stereographic, by its latitude of true scale or by its scale at the pole."""
    a, f = ellipsoid
    e = math.sqrt(f * (2 - f))
    if true_lat is None:
        radius = 2 * a * k0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    else:
        phi = math.radians(abs(true_lat))
        radius = a * _m(phi, e) / _t(phi, e)
        south = true_lat < 0
    return _conic(epsg, lon0, fe, fn, 1.0, ellipsoid, -radius if south else radius, 0.0, -1.0 if south else 1.0)


def _authalic(phi: float, e: float) -> float:
    s = math.sin(phi)
    return (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e)


def _albers(epsg, lat0, lon0, lat1, lat2, fe, fn, ellipsoid):
    a, f = ellipsoid
    e = math.sqrt(f * (2 - f))
    phi0, phi1, phi2 = (math.radians(v) for v in (lat0, lat1, lat2))
    m1, q1, q2 = _m(phi1, e) ** 2, _authalic(phi1, e), _authalic(phi2, e)
    cone = (m1 - _m(phi2, e) ** 2) / (q2 - q1)
    area = m1 + cone * q1
    e2, e4, e6 = e**2, e**4, e**6
    delta = [e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360, 0.0]
    scale = a / cone
    rho0 = scale * math.sqrt(area - cone * _authalic(phi0, e))
    pole = _authalic(math.pi / 2, e)
    return (epsg, "aea", math.radians(lon0), 1.0, fe, fn, 1.0, a, e, None, None, delta, scale, rho0, cone, area, pole, None)


def _plain(epsg, method, ellipsoid=(EARTH_RADIUS, 0.0), shift=None):
    a, f = ellipsoid
    e = math.sqrt(f * (2 - f))
    return (epsg, method, 0.0, 1.0, 0.0, 0.0, 1.0, a, e, None, None, None, None, None, None, None, None, shift)


def crs_rows() -> list[tuple]:
    rows = [_plain(4326, "geographic"), _plain(4269, "geographic"), _plain(3857, "web")]
    rows.append(_plain(4267, "geographic", CLARKE_1866, NAD27_SHIFT))

    def utm(first_code, zones, ellipsoid, north=True, shift=None):
        for zone in zones:
            fn = 0.0 if north else 10000000.0
            rows.append(
                _transverse_mercator(first_code + zone, 0.0, 6.0 * zone - 183.0, 0.9996, 500000.0, fn, 1.0, ellipsoid, shift)
            )

    utm(26900, range(1, 24), GRS80)
    utm(6329, range(1, 20), GRS80)
    utm(32600, range(1, 61), WGS84)
    utm(32700, range(1, 61), WGS84, north=False)
    utm(26700, range(1, 23), CLARKE_1866, shift=NAD27_SHIFT)
    # State-plane definitions in US survey feet (false origins given in metres).
    rows.append(_transverse_mercator(6527, 38.0 + 50.0 / 60.0, -74.5, 0.9999, 150000.0, 0.0, US_FOOT, GRS80))
    rows.append(
        _lambert(3089, 36.0 + 20.0 / 60.0, -85.75, 37.0 + 5.0 / 60.0, 38.0 + 40.0 / 60.0, 1500000.0, 1000000.0, US_FOOT, GRS80)
    )
    # National equal-area systems and polar systems.
    for code in (5070, 6350):
        rows.append(_albers(code, 23.0, -96.0, 29.5, 45.5, 0.0, 0.0, GRS80))
    rows.append(_albers(3338, 50.0, -154.0, 55.0, 65.0, 0.0, 0.0, GRS80))
    rows.append(_albers(3005, 45.0, -126.0, 50.0, 58.5, 1000000.0, 0.0, GRS80))
    rows.append(_albers(3577, 0.0, 132.0, -18.0, -36.0, 0.0, 0.0, GRS80))
    rows.append(_polar(3413, -45.0, 0.0, 0.0, WGS84, true_lat=70.0))
    rows.append(_polar(3995, 0.0, 0.0, 0.0, WGS84, true_lat=71.0))
    rows.append(_polar(3031, 0.0, 0.0, 0.0, WGS84, true_lat=-71.0))
    rows.append(_polar(3032, 70.0, 6000000.0, 6000000.0, WGS84, true_lat=-71.0))
    rows.append(_polar(32661, 0.0, 2000000.0, 2000000.0, WGS84, k0=0.994))
    rows.append(_polar(32761, 0.0, 2000000.0, 2000000.0, WGS84, k0=0.994, south=True))
    return rows


def crs_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(crs_rows(), CRS_SCHEMA)


def with_crs(df: DataFrame, epsg_col: str = "epsg", name: str = "crs") -> DataFrame:
    """Add the CRS parameters of each row's code as struct column ``name`` (null for unknown codes).

    The parameter table has about 200 rows by construction, hence the explicit broadcast.
    """
    table = crs_table(df.sparkSession)
    packed = table.select(
        F.col("epsg").alias("__crs_epsg"), F.struct(*[c for c in table.columns]).alias(name)
    )
    return df.join(F.broadcast(packed), F.col(epsg_col) == F.col("__crs_epsg"), "left").drop("__crs_epsg")


def crs_literal(epsg: int) -> str:
    """CRS parameters of one known code as a constant, in SQL text."""
    for row in crs_rows():
        if row[0] == epsg:
            return crs_text(row)
    raise ValueError(f"unknown EPSG code {epsg}")


def crs_text(row: tuple) -> str:
    """One row of parameters as SQL text."""

    def text(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return f"'{value}'"
        if isinstance(value, list):
            return f"array({', '.join(text(v) for v in value)})"
        return f"{value}" if isinstance(value, int) else f"{value!r}D"

    fields = [f.split(" ") for f in CRS_SCHEMA.split(", ")]
    parts = [f"'{name}', CAST({text(value)} AS {kind})" for value, (name, kind) in zip(row, fields)]
    return f"named_struct({', '.join(parts)})"


# The formulas are SQL text: long expressions are parsed in one go that way, instead of being put together
# by thousands of calls into the JVM. ``c`` names the CRS struct; lambda variables get distinct names.


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _point(x: str, y: str) -> str:
    return f"named_struct('x', {x}, 'y', {y})"


def _sum4(coefficients: str, first: str, second: str = "") -> str:
    """Sum over j = 1..4 of coefficient j times the two factors at multiple 2j."""
    terms = []
    for j in range(4):
        factors = [f"{coefficients}[{j}]", first.format(k=f"{2.0 * (j + 1)}D")]
        if second:
            factors.append(second.format(k=f"{2.0 * (j + 1)}D"))
        terms.append(" * ".join(factors))
    return f"({' + '.join(terms)})"


def _geodetic(conformal: str, c: str) -> str:
    """Latitude in degrees from a conformal latitude."""
    return _let("chi", conformal, f"degrees(chi + {_sum4(f'{c}.delta', 'sin(chi * {k})')})")


def _web_to_lonlat(x: str, y: str) -> str:
    return _point(f"degrees({x} / {EARTH_RADIUS}D)", f"degrees(atan(sinh({y} / {EARTH_RADIUS}D)))")


def _lonlat_to_web(x: str, y: str) -> str:
    return _point(f"{EARTH_RADIUS}D * radians({x})", f"{EARTH_RADIUS}D * asinh(tan(radians({y})))")


def _to_lonlat(x: str, y: str, c: str) -> str:
    east, north = f"({x} * {c}.unit - {c}.fe)", f"({y} * {c}.unit - {c}.fn)"
    straight = f"named_struct('u', {c}.offset + {north} / {c}.scale, 'v', {east} / {c}.scale)"
    primed = "named_struct('u', s.u - {0}, 'v', s.v - {1})".format(
        _sum4(f"{c}.beta", "sin(s.u * {k})", "cosh(s.v * {k})"), _sum4(f"{c}.beta", "cos(s.u * {k})", "sinh(s.v * {k})")
    )
    tm_point = _point(
        f"degrees({c}.lon0 + atan2(sinh(q.v), cos(q.u)))", _geodetic("asin(sin(q.u) / cosh(q.v))", c)
    )
    tm = _let("s", straight, _let("q", primed, tm_point))
    # cones that open to the south have a negative scale
    polar = f"named_struct('e', sign({c}.scale) * {east}, 'd', sign({c}.scale) * ({c}.offset - {north}))"
    radius = f"sqrt(s.e * s.e + s.d * s.d) / abs({c}.scale)"
    cone_lon = f"degrees(atan2(s.e, s.d) / {c}.cone + {c}.lon0)"
    lcc_point = _point(
        cone_lon,
        _geodetic(f"{math.pi / 2}D - 2 * atan(power({radius}, 1 / {c}.cone))", c),
    )
    authalic = f"({c}.area - power({radius}, 2)) / {c}.cone"
    guess = f"ab + {_sum4(f'{c}.delta', 'sin(ab * {k})')}"
    ellipse = f"(1 - {c}.e * {c}.e * sin(ap) * sin(ap))"
    # one Newton step on the authalic function; at the poles, where its slope ends, the series stands alone
    step = f"IF(cos(ap) > 1e-9D, (aq - {_authalic_sql('ap', c)}) * {ellipse} * {ellipse} / (2 * (1 - {c}.e * {c}.e) * cos(ap)), 0D)"
    aea_lat = _let("aq", authalic, _let("ab", f"asin(greatest(least(aq / {c}.pole, 1D), -1D))", _let("ap", guess, f"degrees(ap + {step})")))
    return (
        f"CASE {c}.method WHEN 'geographic' THEN {_point(x, y)} WHEN 'web' THEN {_web_to_lonlat(x, y)} "
        f"WHEN 'tm' THEN {tm} WHEN 'lcc' THEN {_let('s', polar, lcc_point)} "
        f"WHEN 'aea' THEN {_let('s', polar, _point(cone_lon, aea_lat))} END"
    )


def _authalic_sql(phi: str, c: str) -> str:
    sine = f"sin({phi})"
    return f"((1 - {c}.e * {c}.e) * ({sine} / (1 - {c}.e * {c}.e * {sine} * {sine}) + atanh({c}.e * {sine}) / {c}.e))"


def _from_lonlat(x: str, y: str, c: str) -> str:
    tan_chi = f"sinh(atanh(sin(radians({y}))) - {c}.e * atanh({c}.e * sin(radians({y}))))"
    given = f"named_struct('t', {tan_chi}, 'l', radians({x}) - {c}.lon0)"
    primed = "named_struct('u', atan2(s.t, cos(s.l)), 'v', atanh(sin(s.l) / sqrt(s.t * s.t + 1)))"
    u = "(q.u + {0})".format(_sum4(f"{c}.alpha", "sin(q.u * {k})", "cosh(q.v * {k})"))
    v = "(q.v + {0})".format(_sum4(f"{c}.alpha", "cos(q.u * {k})", "sinh(q.v * {k})"))
    tm_point = _point(
        f"({c}.fe + {c}.scale * {v}) / {c}.unit", f"({c}.fn + {c}.scale * ({u} - {c}.offset)) / {c}.unit"
    )
    tm = _let("s", given, _let("q", primed, tm_point))
    rho = f"({c}.scale * exp(-{c}.cone * asinh(s.t)))"
    lcc_point = _point(
        f"({c}.fe + {rho} * sin({c}.cone * s.l)) / {c}.unit",
        f"({c}.fn + {c}.offset - {rho} * cos({c}.cone * s.l)) / {c}.unit",
    )
    aea_rho = f"({c}.scale * sqrt({c}.area - {c}.cone * {_authalic_sql('s.p', c)}))"
    aea_point = _point(f"({c}.fe + r * sin({c}.cone * s.l)) / {c}.unit", f"({c}.fn + {c}.offset - r * cos({c}.cone * s.l)) / {c}.unit")
    aea = _let("s", f"named_struct('p', radians({y}), 'l', radians({x}) - {c}.lon0)", _let("r", aea_rho, aea_point))
    return (
        f"CASE {c}.method WHEN 'geographic' THEN {_point(x, y)} WHEN 'web' THEN {_lonlat_to_web(x, y)} "
        f"WHEN 'tm' THEN {tm} WHEN 'lcc' THEN {_let('s', given, lcc_point)} WHEN 'aea' THEN {aea} END"
    )


def _translated(g: str, source: tuple[str, str], target: tuple[str, str], shift: str, sign: str) -> str:
    """Longitude/latitude on one ellipsoid (axis, eccentricity) -> on another, by a geocentric translation; height 0."""
    (a, e), (a2, e2) = source, target
    normal = f"{a} / sqrt(1 - {e} * {e} * power(sin(radians({g}.y)), 2))"
    lat, lon = f"radians({g}.y)", f"radians({g}.x)"
    moved = (
        f"named_struct('x', n0 * cos({lat}) * cos({lon}) {sign} {shift}[0], 'y', n0 * cos({lat}) * sin({lon}) {sign} {shift}[1], "
        f"'z', n0 * (1 - {e} * {e}) * sin({lat}) {sign} {shift}[2])"
    )
    flat = f"sqrt(1 - {e2} * {e2})"
    bowring = f"atan2(w.z, sqrt(w.x * w.x + w.y * w.y) * {flat})"
    up = f"w.z + {a2} * {e2} * {e2} / {flat} * power(sin(th), 3)"
    out = f"sqrt(w.x * w.x + w.y * w.y) - {a2} * {e2} * {e2} * power(cos(th), 3)"
    return _let("n0", normal, _let("w", moved, _let("th", bowring, _point("degrees(atan2(w.y, w.x))", f"degrees(atan2({up}, {out}))"))))


WGS84_TEXT = (f"{WGS84[0]!r}D", f"{math.sqrt(WGS84[1] * (2 - WGS84[1]))!r}D")


def _to_world(x: str, y: str, c: str) -> str:
    """Point -> longitude, latitude of the common datum."""
    shifted = _translated("own", (f"{c}.a", f"{c}.e"), WGS84_TEXT, f"{c}.shift", "+")
    return _let("own", _to_lonlat(x, y, c), f"CASE WHEN {c}.shift IS NULL THEN own ELSE {shifted} END")


def _from_world(x: str, y: str, c: str) -> str:
    """Longitude, latitude of the common datum -> point."""
    back = _translated("wide", WGS84_TEXT, (f"{c}.a", f"{c}.e"), f"{c}.shift", "-")
    own = f"CASE WHEN {c}.shift IS NULL THEN wide ELSE {back} END"
    return _let("wide", _point(x, y), _let("own", own, _from_lonlat("own.x", "own.y", c)))


def _moved(points: str, source: str, target: str | None) -> str:
    """Points through longitude/latitude into ``target``, or into EPSG:3857 when that is None."""
    out = _lonlat_to_web("g.x", "g.y") if target is None else _from_world("g.x", "g.y", target)
    return f"transform({points}, p -> {_let('g', _to_world('p.x', 'p.y', source), out)})"


def to_lonlat(p: str, crs: str) -> Column:
    """Point (SQL text) in the system described by ``crs`` -> longitude, latitude in degrees."""
    return F.expr(_let("p", p, _to_world("p.x", "p.y", crs)))


def from_lonlat(p: str, crs: str) -> Column:
    """Longitude, latitude in degrees -> point in the system described by ``crs``."""
    return F.expr(_let("p", p, _from_world("p.x", "p.y", crs)))


def reproject_ring(ring: str, source: str, target: str) -> Column:
    """Point-wise transform of a ring column; null when either system is unknown.

    ``source`` and ``target`` are CRS struct columns (see ``with_crs``) or ``crs_literal`` texts.
    """
    return F.expr(f"CASE WHEN {source}.method IS NOT NULL AND {target}.method IS NOT NULL THEN {_moved(ring, source, target)} END")


def web_ring(ring: str, source: str) -> Column:
    """Ring in EPSG:3857; rings already there are passed through unchanged."""
    return F.expr(
        f"CASE WHEN {source}.method = 'web' THEN {ring} WHEN {source}.method IS NOT NULL THEN {_moved(ring, source, None)} END"
    )


def reproject_bbox(box: str, source: str, target: str) -> Column:
    """Box around the four transformed corners; null when the box or either system is missing."""
    b = box
    corners = (
        f"array({_point(f'{b}.xmin', f'{b}.ymin')}, {_point(f'{b}.xmax', f'{b}.ymin')}, "
        f"{_point(f'{b}.xmax', f'{b}.ymax')}, {_point(f'{b}.xmin', f'{b}.ymax')})"
    )
    xs, ys = "transform(m, v -> v.x)", "transform(m, v -> v.y)"
    around = (
        f"named_struct('xmin', array_min({xs}), 'ymin', array_min({ys}), 'xmax', array_max({xs}), 'ymax', array_max({ys}))"
    )
    known = f"{b} IS NOT NULL AND {source}.method IS NOT NULL AND {target}.method IS NOT NULL"
    return F.expr(f"CASE WHEN {known} THEN {_let('m', _moved(corners, source, target), around)} END")


def web_to_lonlat(p) -> Column:
    p = col(p)
    r = F.lit(EARTH_RADIUS)
    return point(F.degrees(p["x"] / r), F.degrees(F.atan(F.sinh(p["y"] / r))))


def lonlat_to_web(p) -> Column:
    p = col(p)
    r = F.lit(EARTH_RADIUS)
    return point(r * F.radians(p["x"]), r * F.asinh(F.tan(F.radians(p["y"]))))


def web_bbox_to_lonlat(box) -> Column:
    """3857 box -> lon/lat box. Both axes are monotone, so two corners decide."""
    b = col(box)
    low, high = web_to_lonlat(point(b["xmin"], b["ymin"])), web_to_lonlat(point(b["xmax"], b["ymax"]))
    return F.when(b.isNotNull(), bbox(low["x"], low["y"], high["x"], high["y"]))


def lonlat_bbox_to_web(box) -> Column:
    b = col(box)
    low, high = lonlat_to_web(point(b["xmin"], b["ymin"])), lonlat_to_web(point(b["xmax"], b["ymax"]))
    return F.when(b.isNotNull(), bbox(low["x"], low["y"], high["x"], high["y"]))
