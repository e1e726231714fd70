"""Spatial join, classes and polygons against brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import crs as C
from tessera.functions import geometry as G
from tessera.functions import polygons
from tessera.functions import tiles as T
from tessera.operators import footprints as P
from tessera.operators import spatial, tilegen

ZOOM = 12
SIZE = 2 * T.WEB_EXTENT / 2**ZOOM


def tile_box(x, y):
    return (-T.WEB_EXTENT + x * SIZE, T.WEB_EXTENT - (y + 1) * SIZE, -T.WEB_EXTENT + (x + 1) * SIZE, T.WEB_EXTENT - y * SIZE)


def boxes(spark, rows):
    return spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double").select(
        "id", G.bbox("xmin", "ymin", "xmax", "ymax").alias("bbox")
    )


def random_boxes(n, seed):
    """Small, elongated, huge, degenerate, tile-aligned and repeated boxes around tile (1000, 1500)."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = i % 6
        x, y = rnd.uniform(995, 1012), rnd.uniform(1495, 1512)
        w, h = {0: (0.3, 0.4), 1: (30, 0.2), 2: (0.1, 25), 3: (900, 700), 4: (2, 3), 5: (0, 0)}[kind]
        if kind == 4:
            x, y = float(int(x)), float(int(y))
        x0, y0, x1, y1 = tile_box(x, y + h - 1)[0], tile_box(x, y + h - 1)[1], tile_box(x + w, y)[0], tile_box(x, y)[3]
        out.append((i, min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)))
    # A pile of copies in one place: one cell with a third of the rows.
    pile = tile_box(1003, 1503)
    out += [(n + j, pile[0] + 1, pile[1] + 1, pile[2] - 1, pile[3] - 1) for j in range(n // 2)]
    return out


@pytest.fixture(scope="module")
def grid(spark):
    tiles = [(ZOOM, x, y) for x in range(994, 1016) for y in range(1494, 1516)]
    return spark.createDataFrame(tiles, "z int, x int, y int")


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_theta_join(spark, grid, seed):
    rows = random_boxes(120, seed)
    found = {tuple(r) for r in spatial.tile_footprint_join(grid, boxes(spark, rows), ZOOM).select("x", "y", "id").collect()}
    listed = spatial.tile_footprint_join(grid, boxes(spark, rows), ZOOM).count()
    naive = set()
    for x in range(994, 1016):
        for y in range(1494, 1516):
            a = tile_box(x, y)
            naive |= {(x, y, i) for i, x0, y0, x1, y1 in rows if x0 <= a[2] and x1 >= a[0] and y0 <= a[3] and y1 >= a[1]}
    assert found == naive
    assert listed == len(naive)


def test_rows_without_a_usable_box_touch_nothing(spark, grid):
    rows = boxes(spark, [(1, math.nan, 0.0, 1.0, 1.0), (2, -math.inf, 0.0, math.inf, 1.0), (3, None, 0.0, 1.0, 1.0)])
    assert spatial.tile_footprint_join(grid, rows, ZOOM).count() == 0


def union_area(rects):
    xs = sorted({v for r in rects for v in (r[0], r[2])})
    ys = sorted({v for r in rects for v in (r[1], r[3])})
    return sum(
        (x1 - x0) * (y1 - y0)
        for x0, x1 in zip(xs, xs[1:]) for y0, y1 in zip(ys, ys[1:])
        if any(r[0] <= x0 and r[2] >= x1 and r[1] <= y0 and r[3] >= y1 for r in rects)
    )


def expected_class(tile, rects):
    hits = [r for r in rects if r[0] <= tile[2] and r[2] >= tile[0] and r[1] <= tile[3] and r[3] >= tile[1]]
    if not hits:
        return "empty", 0
    if len(hits) > 4:
        return "too_many", len(hits)
    if any(r[0] <= tile[0] and r[1] <= tile[1] and r[2] >= tile[2] and r[3] >= tile[3] for r in hits):
        return "interior", len(hits)
    cut = [(max(r[0], tile[0]), max(r[1], tile[1]), min(r[2], tile[2]), min(r[3], tile[3])) for r in hits]
    return ("seam" if union_area(cut) / (SIZE * SIZE) >= 0.999 else "partial"), len(hits)


@pytest.mark.parametrize("polygons_too", [False, True])
def test_classes_equal_brute_force(spark, grid, polygons_too):
    rows = [r for r in random_boxes(90, 5) if r[0] % 6 != 3]
    fp = boxes(spark, rows).withColumn("ring", G.ring_from_bbox("bbox"))
    got = spatial.classify_tiles(grid, fp, ZOOM, ring="ring" if polygons_too else None).collect()
    assert len(got) == grid.count()
    for r in got:
        assert (r["class"], r["cog_count"]) == expected_class(tile_box(r["x"], r["y"]), [b[1:] for b in rows]), (r["x"], r["y"])
        assert r["coverage"] is None or -1e-9 <= r["coverage"] <= 1 + 1e-9


def test_boundary_touch_counts(spark):
    t = tile_box(1000, 1500)
    rows = boxes(spark, [(1, t[2], t[1], t[2] + 10, t[3]), (2, t[2], t[3], t[2] + 5, t[3] + 5)])
    tiles = spark.createDataFrame([(ZOOM, 1000, 1500)], "z int, x int, y int")
    assert spatial.tile_hits(tiles, rows, ZOOM).first()["cog_count"] == 2


def rotated(cx, cy, w, h, angle):
    c, s = math.cos(angle), math.sin(angle)
    return [(cx + c * a - s * b, cy + s * a + c * b) for a, b in ((-w, -h), (w, -h), (w, h), (-w, h))]


def inside(poly, pts):
    ok = np.ones(len(pts), dtype=bool)
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1]):
        ok &= (x2 - x1) * (pts[:, 1] - y1) - (y2 - y1) * (pts[:, 0] - x1) >= 0
    return ok


def test_union_share_matches_sampling():
    rnd = random.Random(3)
    g = (np.arange(400) + 0.5) / 400
    pts = np.stack(np.meshgrid(g, g), axis=-1).reshape(-1, 2)
    target, members, count, expected = [], [], [], []
    for i in range(24):
        k = i % 5
        quads = [rotated(rnd.random(), rnd.random(), rnd.uniform(0.1, 0.8), rnd.uniform(0.1, 0.8), rnd.uniform(0, 3)) for _ in range(4)]
        target.append([(0, 0), (1, 0), (1, 1), (0, 1)])
        members.append([q if j % 2 else q[::-1] for j, q in enumerate(quads)])
        count.append(k)
        expected.append(np.any([inside(q, pts) for q in quads[:k]], axis=0).mean() if k else 0.0)
    got = polygons.union_share(np.array(target, float), np.array(members, float), np.array(count))
    assert np.allclose(got, expected, atol=4e-3)


def test_ring_predicates(spark):
    def ring(points):
        closed = points + points[:1]
        return "array(" + ", ".join(f"named_struct('x', {x!r}D, 'y', {y!r}D)" for x, y in closed) + ")"

    square = ring([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
    diamond = ring([(2.0, 0.5), (2.5, 1.0), (2.0, 1.5), (1.5, 1.0)])
    touching = ring([(1.5, 0.0), (2.0, 0.5), (1.5, 1.0), (1.0, 0.5)])
    small = ring([(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25)])
    row = spark.range(1).select(
        G.ring_intersects(square, diamond), G.ring_intersects(square, touching), G.ring_contains(square, small),
        G.ring_contains(small, square), G.ring_area(diamond),
    ).first()
    assert tuple(row) == (False, True, True, False, 0.5)


def test_native_classes_equal_brute_force(spark):
    """UTM boxes against reprojected tiles: hits by half-planes, coverage by sampling, in plain Python."""
    rows = [(i, 500000.0 + 900 * (i % 6), 4400000.0 + 900 * (i // 6), 500000.0 + 900 * (i % 6) + 880, 4400000.0 + 900 * (i // 6) + 905) for i in range(36)]
    fp = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").select(
        "id", F.lit(26916).alias("epsg"), F.lit(100).alias("width"), G.bbox("x0", "y0", "x1", "y1").alias("native_bbox")
    )
    web = P.with_web_copy(fp).select("id", "native_bbox", F.col("web_bbox").alias("bbox"))
    from tessera.plans import tile_report

    tiles = tile_report.area_tiles(web, 15)
    ringed = tiles.withColumn("b", T.tile_bbox("x", "y", "z")).withColumn("r", G.ring_from_bbox("b"))
    moved = {(r["x"], r["y"]): [(p["x"], p["y"]) for p in r["m"][:4]] for r in ringed.select("x", "y", C.reproject_ring("r", C.crs_literal(3857), C.crs_literal(26916)).alias("m")).collect()}
    got = {(r["x"], r["y"]): r for r in spatial.classify_tiles_native(tiles, web, 15, "native_bbox", "bbox", C.crs_literal(26916)).collect()}
    assert set(got) == set(moved)
    g = (np.arange(300) + 0.5) / 300
    for key, quad in moved.items():
        box = [min(p[0] for p in quad), min(p[1] for p in quad), max(p[0] for p in quad), max(p[1] for p in quad)]
        near = [b[1:] for b in rows if b[1] <= box[2] and b[3] >= box[0] and b[2] <= box[3] and b[4] >= box[1]]
        hits = [b for b in near if not any(
            max((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) for px in (b[0], b[2]) for py in (b[1], b[3])) < 0
            for (x1, y1), (x2, y2) in zip(quad, quad[1:] + quad[:1]))]
        assert got[key]["cog_count"] == len(hits)
        if got[key]["coverage"] is not None:
            pts = np.stack(np.meshgrid(box[0] + g * (box[2] - box[0]), box[1] + g * (box[3] - box[1])), axis=-1).reshape(-1, 2)
            of = inside(quad, pts)
            share = np.any([(pts[:, 0] >= b[0]) & (pts[:, 0] <= b[2]) & (pts[:, 1] >= b[1]) & (pts[:, 1] <= b[3]) for b in hits], axis=0)[of].mean()
            assert abs(share - got[key]["coverage"]) < 0.01


@pytest.mark.parametrize("epsg,lon,lat", [(26916, -87.1, 40.2), (26917, -80.0, 33.3), (32733, 16.0, -24.0), (6527, -74.3, 40.3), (3089, -84.5, 37.7), (3857, 5.0, 52.0),
                                          (5070, -75.0, 35.0), (3338, -150.0, 61.5), (3577, 133.0, -25.0), (3413, 10.0, 81.0), (3031, 120.0, -75.0), (32761, -60.0, -88.0),
                                          (26716, -87.1, 40.2), (4267, -100.0, 40.0)])
def test_crs_round_trip(spark, epsg, lon, lat):
    df = spark.range(1).select(G.point(lon, lat).alias("p")).withColumn("q", C.from_lonlat("p", C.crs_literal(epsg)))
    back = df.select(C.to_lonlat("q", C.crs_literal(epsg)).alias("b")).first()["b"]
    assert math.isclose(back["x"], lon, abs_tol=1e-9) and math.isclose(back["y"], lat, abs_tol=1e-9)


def test_crs_known_points(spark):
    """Central meridian and false origins fall on their defined coordinates."""
    cases = [(26916, -87.0, 0.0, 500000.0, 0.0), (6527, -74.5, 38 + 50 / 60, 492125.0, 0.0), (3089, -85.75, 36 + 20 / 60, 4921250.0, 3280833.3333333335)]
    for epsg, lon, lat, x, y in cases:
        p = spark.range(1).select(G.point(lon, lat).alias("p")).select(C.from_lonlat("p", C.crs_literal(epsg)).alias("q")).first()["q"]
        assert math.isclose(p["x"], x, abs_tol=1e-6) and math.isclose(p["y"], y, abs_tol=1e-6)


def test_crs_published_control_points(spark):
    """Worked examples of the published formulas (one metre's hundredth, as printed)."""
    jamaica = C.crs_text(C._lambert_one(0, 18.0, -77.0, 1.0, 250000.0, 150000.0, 1.0, C.CLARKE_1866))
    albers = C.crs_text(C._albers(0, 23.0, -96.0, 29.5, 45.5, 0.0, 0.0, C.CLARKE_1866))
    cases = [
        (jamaica, -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.80 / 3600, 255966.58, 142493.51, 0.01),
        (albers, -75.0, 35.0, 1885472.7, 1535925.0, 0.1),
        (C.crs_literal(32661), 44.0, 73.0, 3320416.75, 632668.43, 0.01),
        (C.crs_literal(3032), 120.0, -75.0, 7255380.79, 7053389.56, 0.01),
    ]
    for crs, lon, lat, x, y, tolerance in cases:
        p = spark.range(1).select(G.point(lon, lat).alias("p")).select(C.from_lonlat("p", crs).alias("q")).first()["q"]
        assert math.isclose(p["x"], x, abs_tol=tolerance) and math.isclose(p["y"], y, abs_tol=tolerance), (lon, lat, p)


def test_datum_shift(spark):
    """The translation of the mean shift, from geocentric coordinates put together by hand."""
    lon, lat = math.radians(-100.0), math.radians(40.0)
    a, f = C.CLARKE_1866
    e2 = f * (2 - f)
    n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    x, y, z = n * math.cos(lat) * math.cos(lon) - 8, n * math.cos(lat) * math.sin(lon) + 160, n * (1 - e2) * math.sin(lat) + 176
    a2, f2 = C.WGS84
    e2 = f2 * (2 - f2)
    phi = lat
    for _ in range(20):
        n = a2 / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        phi = math.atan2(z + e2 * n * math.sin(phi), math.hypot(x, y))
    got = spark.range(1).select(G.point(-100.0, 40.0).alias("p")).select(C.to_lonlat("p", C.crs_literal(4267)).alias("q")).first()["q"]
    assert math.isclose(got["x"], math.degrees(math.atan2(y, x)), abs_tol=1e-9) and math.isclose(got["y"], math.degrees(phi), abs_tol=1e-9)


def test_tile_range_takes_corners_in_any_order(spark):
    low, high = ((37.0, -90.0), (42.0, -73.0)), ((42.0, -73.0), (37.0, -90.0))
    a, b = (tilegen.one_row_range(spark, v, 8).first()["range"] for v in (low, high))
    assert a == b and a["x_min"] <= a["x_max"] and a["y_min"] <= a["y_max"]


def test_sample_is_repeatable_and_an_empty_one_is_an_error(spark):
    t = tile_box(1000, 1500)
    fp = boxes(spark, [(1, t[0] - 3 * SIZE, t[1] - 3 * SIZE, t[2] + 3 * SIZE, t[3] + 3 * SIZE)])
    rng = spark.range(1).selectExpr("named_struct('x_min', 995, 'x_max', 1005, 'y_min', 1495, 'y_max', 1505) AS range")
    draws = tilegen.classify_draws(rng, fp, ZOOM, 10, seed=4)
    first, second = (sorted(map(tuple, tilegen.sample_tiles(draws, 10).collect())) for _ in range(2))
    assert first == second and len(first) == 10
    stats = tilegen.sample_stats(draws, 10).first()
    assert stats["duplicates"] + sum(stats[c] for c in spatial.TILE_CLASSES) == stats["attempts"] == 2000
    far = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)])
    with pytest.raises(RuntimeError):
        tilegen.require_tiles(tilegen.sample_tiles(tilegen.classify_draws(rng, far, ZOOM, 5, seed=4), 5))


def test_drawing_in_rounds_gives_the_sample_of_all_draws(spark):
    """Rounds stop early, and what they give are the first usable tiles of all attempts; without any, all attempts are made."""
    t = tile_box(1000, 1500)
    fp = boxes(spark, [(1, t[0], t[1], t[2] + 2 * SIZE, t[3] + 2 * SIZE)])
    rng = spark.range(1).selectExpr("named_struct('x_min', 990, 'x_max', 1010, 'y_min', 1490, 'y_max', 1510) AS range")
    everything = tilegen.classify_draws(rng, fp, ZOOM, 5, seed=11)
    rounds = tilegen.classify_in_rounds(rng, fp, ZOOM, 5, seed=11, first=8)
    want, got = (sorted(map(tuple, tilegen.sample_tiles(d, 5).collect())) for d in (everything, rounds))
    assert want == got and len(got) == 5
    assert rounds.count() < everything.count()
    far = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)])
    none = tilegen.classify_in_rounds(rng, far, ZOOM, 5, seed=11)
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, tilegen.classify_draws(rng, far, ZOOM, 5, seed=11).collect()))


def test_tiles_are_never_broadcast(spark):
    """Grids of any size meet the footprints in the same join, and no job runs while it is planned."""
    fp = spark.range(20000).select("id", G.bbox("id * 100", "id * 50", "id * 100 + 90", "id * 50 + 40").alias("bbox"))

    def plan_and_count(x_max, y_max):
        rng = spark.range(1).selectExpr(f"named_struct('x_min', 8192, 'x_max', {8192 + x_max}, 'y_min', 7600, 'y_max', {7600 + y_max}) AS range")
        joined = spatial.tile_footprint_join(tilegen.tile_grid(rng, 14), fp, 14)
        n = joined.where("x <= 8200 AND y <= 8191").count()
        return joined._jdf.queryExecution().executedPlan().toString(), n

    small, n_small = plan_and_count(8, 591)
    large, n_large = plan_and_count(999, 591)
    assert n_small == n_large > 0
    for plan in (small, large):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and "NestedLoop" not in plan


def test_boxes_of_binary_geometries():
    """Both byte orders, nesting, further dimensions, and what gives no box."""
    import struct

    import numpy as np
    import pandas as pd

    from tessera.functions import wkb

    def ring(order, *points):
        return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "d" * len(p), *p) for p in points)

    def geometry(order, kind, body):
        return struct.pack(order + "BI", order == "<", kind) + body

    plain = [(1.0, 2.0), (4.0, 2.0), (4.0, 6.0), (1.0, 2.0)]
    high = [(*p, 9e9) for p in plain]
    little, big = (geometry(o, 3, struct.pack(o + "I", 1) + ring(o, *plain)) for o in "<>")
    other = geometry(">", 3, struct.pack(">I", 2) + ring(">", (-5.0, 0.0), (0.0, 0.0), (-5.0, 0.0)) + ring(">", (-1.0, 0.0), (-1.0, 1.0), (-1.0, 0.0)))
    several = geometry("<", 6, struct.pack("<I", 2) + little + other)
    collection = geometry(">", 7, struct.pack(">I", 2) + several + geometry("<", 1, struct.pack("<dd", 50.0, -50.0)))
    with_height = geometry("<", 1003, struct.pack("<I", 1) + ring("<", *high))
    extended = geometry("<", 0x80000000 | 0x20000000 | 3, struct.pack("<I", 4326) + struct.pack("<I", 1) + ring("<", *high))
    nan = geometry("<", 3, struct.pack("<I", 1) + ring("<", (float("nan"), 1.0), (2.0, 2.0)))
    empty = geometry("<", 6, struct.pack("<I", 0))
    cases = [
        (little, (1, 2, 4, 6)), (big, (1, 2, 4, 6)), (other, (-5, 0, 0, 1)), (several, (-5, 0, 4, 6)), (collection, (-5, -50, 50, 6)),
        (with_height, (1, 2, 4, 6)), (extended, (1, 2, 4, 6)), (geometry("<", 1, struct.pack("<dd", 3.0, 4.0)), (3, 4, 3, 4)),
        (nan, None), (empty, None), (None, None), (b"", None), (little[:-3], None), (b"\x01text", None), (geometry("<", 77, b""), None), (little, (1, 2, 4, 6)),
    ]
    got = wkb.boxes_of(pd.Series([c for c, _ in cases], dtype=object))
    for row, (_, want) in zip(got, cases):
        assert np.isnan(row).all() if want is None else tuple(row) == want
    assert wkb.boxes_of(pd.Series([], dtype=object)).shape == (0, 4)


def test_classes_of_a_range_equal_classes_of_its_tiles(spark):
    """Small, large, piled and distant footprints, with and without collections and rings; tiles on both sides of row 0."""
    from tessera.plans import tile_report

    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], *(v := (-9e6 + rng.random() * 9e5, 4e6 + rng.random() * 9e5)), v[0] + rng.random() * 4e4, v[1] + rng.random() * 4e4) for i in range(60)]
    rows += [(100 + i, "a", -8.8e6, 4.2e6, -8.5e6, 4.5e6) for i in range(7)] + [(200, "b", -9e6, 2.1e7, -8.9e6, 2.11e7), (201, None, -9e6, 4e6, -8.9e6, 4.1e6)]
    fp = spark.createDataFrame(rows, "id long, c string, x0 double, y0 double, x1 double, y1 double").select(
        "id", "c", G.bbox("x0", "y0", "x1", "y1").alias("bbox")
    ).withColumn("ring", G.ring_from_bbox("bbox"))

    def rounded(df):
        return sorted(map(repr, df.withColumn("coverage", F.round("coverage", 6)).collect()))

    for by, ring in (((), None), (("c",), None), ((), "ring")):
        ranges = tile_report.covered_range(fp, 11, by=by)
        want = spatial.classify_tiles(tilegen.tile_grid(ranges, 11, by), fp, 11, on=by, ring=ring)
        got = spatial.classify_range(ranges, fp, 11, on=by, ring=ring)
        assert got.schema["z"].dataType == want.schema["z"].dataType and got.columns == want.columns
        assert rounded(got) == rounded(want)
    plan = spark._jvm.PythonSQLUtils.explainString(spatial.classify_range(ranges, fp, 11)._jdf.queryExecution(), "simple")
    assert "collect_top_k" not in plan


def test_native_classes_of_a_range_reproject_tiles_near_footprints_only(spark):
    """Two footprints far apart span 30 million tiles, all of them counted; a smaller range is compared tile by tile."""
    from tessera.plans import tile_report

    def web(rows):
        fp = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").select(
            "id", F.lit(26916).alias("epsg"), F.lit(100).alias("width"), G.bbox("x0", "y0", "x1", "y1").alias("native_bbox")
        )
        return P.with_web_copy(fp).select("id", "native_bbox", F.col("web_bbox").alias("bbox"))

    crs = C.crs_literal(26916)
    near = web([(i, 500000.0 + 900 * (i % 5), 4400000.0 + 9000 * (i // 5), 500000.0 + 900 * (i % 5) + 1800, 4400000.0 + 9000 * (i // 5) + 1905) for i in range(15)])
    want = spatial.classify_tiles_native(tile_report.area_tiles(near, 15), near, 15, "native_bbox", "bbox", crs)
    got = spatial.classify_range_native(tile_report.covered_range(near, 15), near, 15, "native_bbox", "bbox", crs)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

    far = web([(1, 300000.0, 4300000.0, 301000.0, 4301000.0), (2, 700000.0, 8300000.0, 701000.0, 8301000.0)])
    ranges = tile_report.covered_range(far, 17)
    r = ranges.select("range.*").first()
    stats = spatial.class_stats(spatial.classify_range_native(ranges, far, 17, "native_bbox", "bbox", crs)).first()
    assert stats["tiles"] == (r["x_max"] - r["x_min"] + 1) * (r["y_max"] - r["y_min"] + 1) > 30_000_000
    assert 20 < stats["tiles"] - stats["empty"] < 500


def part_table(spark, folder):
    """Footprints side by side, some of them two and six times, and the tables' SQL over them."""
    import duckdb

    keys = [*range(300), *range(60, 70), *(k for k in range(120, 126) for _ in range(5))]
    spark.createDataFrame([(k, "box") for k in keys], "p_partkey long, p_type string").coalesce(1).write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    return con


def holds_without_broadcast(df, con, sql):
    """The SQL's rows, and no join that the driver would have to hold a side of, neither planned nor taken up at run time."""
    from compare import compare

    n, _, problem = compare(df, con, sql)
    assert n and problem is None, problem
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_class_stats_broadcasts_no_tiles(spark, tmp_path):
    from compare import compare
    from tessera.checks.common import footprints
    from tessera.checks.spatial import QUERIES
    from tessera.plans import tile_report

    query, sql = QUERIES["class_stats"]
    con = part_table(spark, tmp_path)
    assert compare(query(spark, str(tmp_path)), con, sql) == (4, 4, None)
    one = tile_report.area_report(footprints(spark, str(tmp_path)), 16).withColumn("zoom", F.lit(16))
    holds_without_broadcast(one, con, f"SELECT * FROM ({sql}) WHERE zoom = 16")
    # one for the count and one for the members, each planned and run: the range is not copied to where it is used
    assert one._jdf.queryExecution().executedPlan().toString().count("Subquery subquery#") <= 8


def test_classify_tiles_broadcasts_no_tiles(spark, tmp_path):
    from tessera.checks.spatial import QUERIES

    query, sql = QUERIES["classify_tiles"]
    con = part_table(spark, tmp_path)
    holds_without_broadcast(query(spark, str(tmp_path)), con, sql)


def test_usable_tiles_broadcasts_no_tiles(spark, tmp_path):
    from tessera.checks.spatial import QUERIES

    query, sql = QUERIES["usable_tiles"]
    con = part_table(spark, tmp_path)
    holds_without_broadcast(query(spark, str(tmp_path)), con, sql)
