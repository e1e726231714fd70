"""Footprints, ranks, catalog, staging, sinks, jobs and streams on hand-made inputs."""

import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as X
from tessera.operators import catalog as K
from tessera.operators import footprints as P
from tessera.operators import ranks, spatial, staging, telemetry
from tessera.plans import refresh, scan
from tessera.sinks import generations, writers
from tessera.sources import files, readers
from tessera.streaming import telemetry as ST

RING = "array<struct<x:double,y:double>>"


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def features(spark, rows):
    return spark.createDataFrame(rows, f"collection_id string, key string, epsg int, native_ring {RING}, web_ring {RING}")


# --- footprints -------------------------------------------------------------------------------


def test_epsg_groups_count_native_and_web_apart(spark):
    s = square(0.0, 0.0, 1.0, 1.0)
    df = features(spark, [("t", "a.tif", 26917, s, s), ("t", "b.tif", 26918, s, None), ("t", "c.tif", None, s, s)])
    got = {r["epsg"]: (r["native_count"], r["web_count"]) for r in P.group_by_epsg(df).collect()}
    assert got == {26917: (1, 1), 26918: (1, 0), None: (1, 1)}


def test_extent_skips_points_that_are_not_finite(spark):
    bad = [(math.inf, 0.0), (math.inf, 1.0), (math.nan, 0.0)]
    df = features(spark, [("t", "bad", None, bad, None), ("t", "ok", None, square(5.0, 5.0, 10.0, 10.0), None)])
    assert tuple(P.extent(df).first()["extent"]) == (5.0, 5.0, 10.0, 10.0)
    assert P.extent(df.where("key = 'bad'")).first()["extent"] is None
    assert P.extent(df.where("key = 'none'")).first()["extent"] is None


def test_missing_codes(spark):
    s = square(0.0, 0.0, 1.0, 1.0)
    one = [("one", "a", 26917, s, s), ("one", "b", None, s, s)]
    two = [("two", "a", 26917, s, s), ("two", "b", 26918, s, s), ("two", "c", None, s, s)]
    df = features(spark, one + two)
    got = {(r["collection_id"], r["key"]): r["epsg"] for r in P.fill_epsg(df).collect()}
    assert got[("one", "b")] == 26917 and got[("two", "c")] is None
    assert P.fill_epsg(df, override=3089).where("epsg = 3089").count() == 2


def test_unknown_system_drops_only_the_web_copy(spark):
    h = spark.createDataFrame(
        [("b", "p/a.tif", 'PROJCS["x",AUTHORITY["EPSG","99999"]]', [0.0, 1.0, 0.0, 10.0, 0.0, -1.0], 10, 10, 3, "Byte"),
         ("b", "p/b.tif", 'PROJCS["x",AUTHORITY["EPSG","26916"]]', [500000.0, 1.0, 0.5, 4400000.0, 0.0, -1.0], 1000, 1000, 0, "Byte")],
        readers.HEADER_SCHEMA,
    )
    rows = {r["key"]: r for r in P.build_footprints(h, "c", requester_pays=True).collect()}
    assert rows["p/a.tif"]["web_ring"] is None and rows["p/a.tif"]["native_bbox"]["ymin"] == 0.0 and rows["p/a.tif"]["native_zoom"] is None
    b = rows["p/b.tif"]
    assert b["native_bbox"]["xmax"] == 501500.0 and b["web_ring"] is not None and b["data_type"] == "unknown"
    assert b["location"] == "/vsicurl/http://localhost:8001/requester-pays/us-west-2/b/p/b.tif"


def test_median_zoom_is_the_upper_median_rounded_half_even(spark):
    df = spark.createDataFrame([("a", 16.5), ("a", 17.5), ("b", 16.5), ("c", None)], "collection_id string, native_zoom double")
    got = {r["collection_id"]: r["native_zoom"] for r in P.median_native_zoom(df).collect()}
    assert got == {"a": 18, "b": 16, "c": 18}


def test_scan_report_blocks_publication(spark):
    df = features(spark, [("t", f"k{i:03}", 1, square(0.0, 0.0, 1.0, 1.0), None) for i in range(30)])
    r = P.scan_report(df.withColumn("error", F.when(F.col("key") < "k025", F.concat(F.lit("bad "), "key")))).first()
    assert (r["discovered"], r["scanned"], r["failures"], r["publishable"]) == (30, 5, 25, False)
    assert r["first_failures"] == [f"bad k{i:03}" for i in range(20)]


# --- ranks ------------------------------------------------------------------------------------


def test_rank_percentiles_equal_sorted_positions(spark):
    rnd = random.Random(8)
    data = {
        "hot": [0.5] * 3000 + [rnd.uniform(0.4, 0.6) for _ in range(500)],
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(700)],
        "powers": [2.0**k for k in range(-40, 40)] + [math.nextafter(2.0**k, 0) for k in range(-40, 40)],
        "zero": [0.0, -0.0, 5e-324, -5e-324, 1e-310, -1e-310],
        "one": [7.25],
        None: [3.0, 1.0, 2.0],
    }
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("hot", None), ("one", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in ranks.rank_percentiles(df, "v", probs, ("g",)).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        s = sorted(vs)
        for name, p in probs.items():
            assert got[g][name] == s[min(len(s) - 1, int(len(s) * p))], (g, name)
    whole = sorted(v for vs in data.values() for v in vs)
    assert ranks.rank_percentiles(df, "v", {"m": 0.5}).first()["m"] == whole[len(whole) // 2]


def test_group_limits_run_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("job_id"), F.col("id").alias("line_no"))
    tail = ranks.log_tail(df, n=5)
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert tail.count() == 15


def test_benchmark_summary_cuts_to_milliseconds(spark):
    rows = [("r", 0.0019, True), ("r", 0.0021, True), ("r", 0.0109, False)]
    s = telemetry.benchmark_summary(spark.createDataFrame(rows, "run_id string, duration_s double, ok boolean")).first()
    assert (s["requests"], s["success"], s["failed"], s["avg_ms"], s["p50_ms"], s["p95_ms"]) == (3, 2, 1, 4, 2, 10)


# --- catalog ----------------------------------------------------------------------------------


def catalog_of(spark, docs, version=1):
    doc = json.dumps({"version": version, "collections": docs})
    return readers.parse_catalog(spark.createDataFrame([(doc,)], "doc string"))


def as_documents(catalog):
    return [json.loads(r["value"]) for r in writers.catalog_lines(catalog).orderBy("position").collect()]


def test_upsert_keeps_fields_the_entry_lacks(spark):
    old = catalog_of(spark, [{"id": "nj", "raster_processing": ["BANDS=1"], "cog_count": 5, "note": {"by": "hand"}}, {"id": "ky", "cog_count": 1}])
    new = catalog_of(spark, [{"id": "new", "cog_count": 7}, {"id": "nj", "cog_count": 6, "note": None}])
    assert as_documents(K.upsert_catalog(old, new)) == [
        {"id": "nj", "raster_processing": ["BANDS=1"], "cog_count": 6, "note": None},
        {"id": "ky", "cog_count": 1},
        {"id": "new", "cog_count": 7},
    ]


def test_catalog_files(spark, tmp_path, capsys):
    path = f"{tmp_path}/collections.json"
    assert readers.read_catalog(spark, path).count() == 0
    writers.upsert_catalog_document(catalog_of(spark, [{"id": "fresh", "label": "Fresh"}]), path)
    doc = json.loads(open(path).read())
    assert doc["version"] == 1 and [c["id"] for c in doc["collections"]] == ["fresh"]
    assert "WARN" not in capsys.readouterr().err
    with open(f"{tmp_path}/old.json", "w") as f:
        f.write('{"version": 99, "collections": []}')
    writers.upsert_catalog_document(catalog_of(spark, [{"id": "x"}]), f"{tmp_path}/old.json")
    assert "WARN" in capsys.readouterr().err
    with open(f"{tmp_path}/broken.json", "w") as f:
        f.write("{not json")
    assert readers.read_catalog(spark, f"{tmp_path}/broken.json").count() == 0
    with pytest.raises(ValueError):
        K.delete_collection(readers.read_catalog(spark, path), "gone")


def test_groups_are_made_up_when_missing(spark):
    single = {"id": "one", "native_epsg": 6527, "tileindex": "/m/one.fgb", "layer_name": "one-layer", "tileindexes": []}
    multi = {"id": "two", "native_epsg": 26917, "tileindexes": [{"epsg": 26917, "tileindex": "/m/a.fgb"}, {"epsg": 26918, "tileindex": "/m/b.fgb", "layer_name": "b", "mixed_srs": True}]}
    rows = {(r["id"], r["epsg"]): r for r in K.collection_groups(K.typed(catalog_of(spark, [single, multi]))).collect()}
    assert rows[("one", 6527)]["index_layer"] == "cog-tileindex-one" and rows[("one", 6527)]["layer_name"] == "one-layer"
    assert rows[("two", 26917)]["index_layer"] == "cog-tileindex-two-26917" and rows[("two", 26917)]["layer_name"] == "two"
    assert rows[("two", 26918)]["mixed_srs"] is True and list(rows[("two", 26918)]["processing"]) == ["BANDS=1,2,3", "RESAMPLE=AVERAGE"]


# --- selections -------------------------------------------------------------------------------


def test_selection_documents(spark):
    got = readers.read_selections(spark, '{"vt": 2019, "nh": "2018", "me": 2019}').select("state", "year").collect()
    assert [tuple(r) for r in got] == [("nh", 2018), ("me", 2019), ("vt", 2019)]
    own = readers.read_selections(spark, '[{"year": 2016, "state": "Wa", "uri": "s3://lake-a/wa/part.parquet", "label": "Washington"}]').first()
    assert (own["state"], own["year"], own["uri"], own["label"]) == ("wa", 2016, "s3://lake-a/wa/part.parquet", "Washington")


@pytest.mark.parametrize("raw", ["", "{}", "no json", '{"or": null}', '{"oregon": 2019}', '{"or": 20.5}', '{"or": 99999}', '[{"state": "or", "year": 2019}, {"state": "OR ", "year": "2019"}]'])
def test_bad_selections(spark, raw):
    with pytest.raises(ValueError):
        readers.read_selections(spark, raw)


def test_split_uri(spark):
    one = spark.createDataFrame([("s3://lake-a/wa/2016/part.parquet",), ("s3://lake-a",)], "u string")
    assert tuple(one.limit(1).select(X.split_s3_uri("u").alias("s")).first()["s"]) == ("lake-a", "wa/2016/part.parquet")
    with pytest.raises(Exception, match="invalid S3 URI"):
        one.select(X.split_s3_uri("u").alias("s")).collect()


# --- sinks and jobs ---------------------------------------------------------------------------


def index_frame(spark, rows):
    return spark.createDataFrame(rows, "collection_id string, native_epsg int, key string")


def test_tile_index_replaces_whole_collections(spark, tmp_path):
    path = f"{tmp_path}/index"
    writers.write_tile_index(index_frame(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]), path)
    writers.write_tile_index(index_frame(spark, [("a", 2, "w"), ("a", None, "v")]), path)
    got = sorted((r["collection_id"], r["native_epsg"], r["key"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 2, "w"), ("b", 1, "z")]
    assert [n for n in files.children(spark, path) if n.startswith("_draft")] == []


def test_replace_and_delete_collection(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert writers.replace_collection(index_frame(spark, [("a", 1, "x"), ("a", 2, "y")]), path, "a") == 2
    assert writers.replace_collection(index_frame(spark, [("b", 1, "z")]), path, "b") == 1
    assert writers.replace_collection(index_frame(spark, [("a", 1, "q")]), path, "a") == 1
    assert sorted(r["key"] for r in spark.read.parquet(path).collect()) == ["q", "z"]
    assert writers.delete_index_rows(spark, path, "b") == 1 and writers.delete_index_rows(spark, path, "b") == 0


def test_window_opens_only_files_that_meet_it(spark, tmp_path):
    """File boxes choose the files; names with marks, null and NaN boxes, windows without files, and indexes without boxes."""
    rows = spark.range(4000).selectExpr(
        "id", "concat('r [', cast(id % 3 as string), ']*') AS region",
        "CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN named_struct('xmin', 0D, 'ymin', 0D, 'xmax', double('nan'), 'ymax', 1D) "
        "ELSE named_struct('xmin', id % 100 * 1D, 'ymin', floor(id / 100) * 1D, 'xmax', id % 100 + 0.5D, 'ymax', floor(id / 100) + 0.5D) END AS bbox",
    )
    path = f"{tmp_path}/staged"
    writers.write_staged_index(rows, path, partition_by=("region",), partitions=12, world=180.0, tie=("id",))
    assert spark.read.parquet(path).count() == 4000  # the table of boxes is no part of the index
    for window in ((10.0, 10.0, 20.0, 12.0), (-5.0, -5.0, 200.0, 200.0), (500.0, 500.0, 501.0, 501.0)):
        found = readers.read_window(spark, path, window)
        want = spatial.bbox_window(spark.read.parquet(path), window)
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in want.collect())
        boxes = {r["file"]: r for r in spark.read.parquet(f"{path}/_boxes").collect()}
        met = {f for f, b in boxes.items() if b["xmin"] is not None and b["xmin"] <= window[2] and (b["xmax"] >= window[0] or math.isnan(b["xmax"])) and b["ymin"] <= window[3] and b["ymax"] >= window[1]}
        if met:
            assert {files.unescaped(files.bare_text(f))[len(path) + 1:] for f in found.inputFiles()} == met
        assert len(boxes) > 6 and sum(b["n"] for b in boxes.values()) == 4000
    assert 0 < len(readers.read_window(spark, path, (10.0, 10.0, 20.0, 12.0)).inputFiles()) < len(boxes)
    files.remove(spark, f"{path}/_boxes")
    assert readers.read_window(spark, path, (10.0, 10.0, 20.0, 12.0)).count() == len([1 for r in rows.collect() if r["bbox"] and r["bbox"]["xmin"] <= 20 and (r["bbox"]["xmax"] >= 10 or math.isnan(r["bbox"]["xmax"])) and r["bbox"]["ymin"] <= 12 and r["bbox"]["ymax"] >= 10])


def test_staged_index_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(10000).select("id", G.bbox("id % 100", "floor(id / 100)", "id % 100 + 1", "floor(id / 100) + 1").alias("bbox"))
    path = f"{tmp_path}/staged"
    writers.write_staged_index(df, path, partitions=1, world=180.0)
    meta = pq.ParquetFile(next(tmp_path.glob("staged/part-*.parquet"))).metadata
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) == 2048
    assert meta.row_group(0).column(0).compression == "ZSTD"
    narrow = meta.row_group(0).column(1).statistics
    assert narrow.max - narrow.min < 99, "each row group covers part of the area"
    from tessera.operators import spatial

    found = spatial.bbox_window(spark.read.parquet(path), (10.5, 10.5, 12.5, 12.5), max_rows=None)
    assert found.count() == 9
    assert "bbox.xmin" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_failed_generation_leaves_the_old_one(spark, tmp_path):
    root = f"{tmp_path}/gen"
    first = generations.publish_generation(spark.range(5), root)

    def refuse(_df):
        raise RuntimeError("not good enough")

    with pytest.raises(RuntimeError):
        generations.publish_generation(spark.range(7), root, validate=refuse)
    assert generations.current_generation(spark, root) == first and generations.read_generation(spark, root).count() == 5
    assert generations.status(spark, root)["status"] == "failed"
    with pytest.raises(RuntimeError):
        generations.publish_generation(spark.range(7), root, expected_rows=8)
    second = generations.publish_generation(spark.range(7), root)
    assert generations.read_generation(spark, root).count() == 7 and second != first
    assert [n for n in files.children(spark, root) if n.startswith("generation=")] == [f"generation={second}"]


def headers(spark, n, fail=False):
    wkt = 'PROJCS["NAD83 / UTM zone {z}N",AUTHORITY["EPSG","{c}"]]'
    rows = [
        ("imagery", f"p/{i:03}.tif", wkt.format(z=16 + i % 2, c=26916 + i % 2), [500000.0 + 1000 * i, 0.5, 0.0, 4400000.0, 0.0, -0.5], 2000, 2000, 3, "Byte",
         "failed to open" if fail and i == 3 else None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, readers.HEADER_SCHEMA + ", error string")


def test_scan_job(spark, tmp_path):
    index, table, catalog = (f"{tmp_path}/{n}" for n in ("index", "table", "catalog.json"))
    report = scan.scan_collection(headers(spark, 12), scan.ScanSettings("ky-2024", bucket="imagery"), index, table, catalog)
    assert (report["discovered"], report["failures"], report["loaded"]) == (12, 0, 12)
    assert readers.read_index(spark, index, "ky-2024").groupBy("native_epsg").count().count() == 2
    doc = json.loads(open(catalog).read())["collections"][0]
    assert doc["id"] == "ky-2024" and doc["native_epsgs"] == [26916, 26917] and doc["layer_names"] == ["ky-2024-26916", "ky-2024-26917"]
    assert doc["native_zoom"] == 18 and doc["min_zoom"] == 14 and doc["max_zoom"] == 19 and doc["postgis"] is True
    with pytest.raises(RuntimeError, match="Failed to scan 1 files"):
        scan.scan_collection(headers(spark, 12, fail=True), scan.ScanSettings("other"), index, table, catalog)
    assert readers.read_index(spark, index, "other").count() == 0


def test_refresh_job(spark, tmp_path):
    lake, target, catalog = f"{tmp_path}/lake", f"{tmp_path}/target", f"{tmp_path}/catalog.json"
    rows = spark.range(400).select(
        F.lit("naip").alias("collection"), F.expr("element_at(array('tx', 'ct', 'na'), cast(id % 3 + 1 as int))").alias("region"),
        F.expr("cast(2019 + id % 4 as int)").alias("year"), F.lit("b").alias("source_bucket"), F.expr("concat('k/', id, '.tif')").alias("source_key"),
        F.expr("cast(26910 + id % 2 as int)").alias("proj_epsg"), G.bbox("-100 + id * 0.01", "30", "-99.9 + id * 0.01", "30.1").alias("bbox"),
    )
    rows.write.partitionBy("collection", "region", "year").parquet(lake)
    template = "s3://footprints/region={state}/year={year}/data_0.parquet"
    refresh.refresh(spark, '{"tx": 2020, "ct": 2019}', lake, target, template, catalog_path=catalog)
    got = generations.read_generation(spark, target)
    want = rows.where("(region = 'tx' and year = 2020) or (region = 'ct' and year = 2019)").count()
    assert got.count() == want > 0
    docs = json.loads(open(catalog).read())["collections"]
    assert [c["id"] for c in docs] == ["naip-ct-2019", "naip-tx-2020"] and sum(c["cog_count"] for c in docs) == want
    assert docs[0]["tileindexes"][0]["mixed_srs"] is True and docs[0]["source"]["uri"].endswith("region=ct/year=2019/data_0.parquet")
    before = generations.current_generation(spark, target)
    with pytest.raises(RuntimeError, match="no footprints for selection"):
        refresh.refresh(spark, '{"tx": 2020, "zz": 2020}', lake, target, template)
    assert generations.current_generation(spark, target) == before


def test_codes_of_nested_wkt(spark):
    geog = 'GEOGCS["NAD83",DATUM["D",SPHEROID["GRS 1980",6378137,298.257222101,AUTHORITY["EPSG","7019"]],AUTHORITY["EPSG","6269"]],UNIT["degree",0.01],AUTHORITY["EPSG","4269"]]'
    proj = f'PROJCS["NAD83 / zone, [odd] name",{geog},PROJECTION["Transverse_Mercator"],UNIT["metre",1,AUTHORITY["EPSG","9001"]]{{}}]'
    code = ',AUTHORITY["EPSG","26916"]'
    cases = [
        (proj.format(code), 26916), (proj.format(""), None), (geog, 4269), (proj.format(code) + "  ", 26916),
        (f'COMPD_CS["both",{proj.format(code)},VERT_CS["NAVD88",VERT_DATUM["V",2005,AUTHORITY["EPSG","5103"]],AUTHORITY["EPSG","5703"]],AUTHORITY["EPSG","5498"]]', 5498),
        (f'COMPD_CS["both",{proj.format(code)},VERT_CS["NAVD88",VERT_DATUM["V",2005,AUTHORITY["EPSG","5103"]],AUTHORITY["EPSG","5703"]]]', 26916),
        (f'COMPD_CS["both",{geog},VERT_CS["NAVD88",AUTHORITY["EPSG","5703"]]]', None),
        ('LOCAL_CS["site",UNIT["metre",1,AUTHORITY["EPSG","9001"]]]', None), ('LOCAL_CS["site",AUTHORITY["ESRI","102100"]]', None),
        ("", None), (None, None), ("]]] no wkt", None), ('projcs["x",authority["epsg","32633"]]', 32633),
    ]
    rows = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(cases)], "id int, wkt string")
    got = {r["id"]: r["e"] for r in rows.select("id", X.epsg_from_wkt("wkt").alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}
    assert {r[0] for r in rows.select(X.epsg_from_wkt("wkt", F.lit(5070))).collect()} == {26916, 5070, 4269, 5498, 32633}


# --- sources and streams ----------------------------------------------------------------------


def test_listing_reads_no_contents(spark, tmp_path):
    for name in ("a/x.TIF", "a/y.tiff", "a/z.txt", "b/w.tif"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"12345")
    got = readers.list_rasters(spark, str(tmp_path), "a/")
    assert sorted(r["key"] for r in got.collect()) == ["a/x.TIF", "a/y.tiff"]
    assert "content" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    stats = telemetry.storage_stats(readers.storage_listing(spark, str(tmp_path))).first()
    assert (stats["files"], stats["bytes"]) == (4, 20)


def test_feature_documents(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"key": "a.tif", "epsg": 26917, "width": 5}, "geometry": {"type": "Polygon", "coordinates": [square(0.0, 0.0, 1.0, 1.0)]}}
    (tmp_path / "named.json").write_text(json.dumps({"type": "FeatureCollection", "name": "layer-1", "features": [feature]}))
    (tmp_path / "plain.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=1))
    rows = readers.read_features(spark, str(tmp_path)).collect()
    assert sorted(r["layer"] for r in rows) == ["layer-1", "plain", "plain"] and len(rows[0]["ring"]) == 5 and rows[0]["epsg"] == 26917


def test_access_log_lines(spark, tmp_path):
    line = {"timestamp": "2024-05-01T10:00:00+00:00", "remote_addr": "1.2.3.4", "method": "GET", "uri": "/mapserv", "args": "REQUEST=GetMap", "status": 200, "size": 10, "upstream_time_s": "0.1, 0.2", "total_time_s": 0.4}
    (tmp_path / "log.json").write_text("\n".join(json.dumps({**line, "args": a}) for a in ("REQUEST=GetMap", "REQUEST=getmap")))
    log = telemetry.with_numbers(telemetry.getmap_only(readers.read_access_log(spark, str(tmp_path))))
    assert [(r["upstream_time_s"], r["size"]) for r in log.collect()] == [(0.0, 10)]


def test_scan_log_lines(spark, tmp_path):
    (tmp_path / "job-1.log").write_text("1\tDiscovered 40 GeoTIFFs under s3://b/p/\n2\tScanned 10/40; failures=1\n3\tScanned 40/40; failures=2\n4\tdone\n")
    row = telemetry.job_rollup(readers.read_scan_log(spark, str(tmp_path))).first()
    assert tuple(row) == ("job-1", 40, 40, 2)


def test_last_samples_over_several_batches(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, args string, upstream_time_s string"
    source, state = tmp_path / "in", ST.BatchedState(f"{tmp_path}/state", ST.SAMPLE_SCHEMA)
    source.mkdir()

    def add(ids):
        lines = [json.dumps({"event_id": i, "ts": f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z", "args": "GetMap", "upstream_time_s": "1.5"}) for i in ids]
        (source / f"{uuid.uuid4().hex}.json").write_text("\n".join(lines))

    def run():
        stream = spark.readStream.schema(schema).json(str(source))
        ST.last_samples(stream, state, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    add(range(0, 150))
    run()
    add(range(150, 180))
    add(range(10, 20))
    run()
    assert sorted(r["event_id"] for r in state.current(spark).collect()) == list(range(80, 180))


def test_untagged_header_keeps_its_row(spark, tmp_path):
    """A header without a code in a collection of one code gets that code before its ring is moved to the web system."""
    gt = [500000.0, 1.0, 0.0, 4300000.0, 0.0, -1.0]
    tagged = 'PROJCS["UTM 16N",AUTHORITY["EPSG","26916"]]'
    rows = [("b", "a.tif", tagged, gt, 100, 100, 3, "Byte"), ("b", "b.tif", None, gt, 100, 100, 3, "Byte")]
    found = P.build_footprints(spark.createDataFrame(rows, readers.HEADER_SCHEMA), "c", fill_gaps=True)
    assert {(r["key"], r["native_epsg"]) for r in P.index_rows(found).collect()} == {("a.tif", 26916), ("b.tif", 26916)}


def test_root_name_below_the_root(spark, tmp_path):
    root = tmp_path / "data"
    for name in ("one.tif", "x/data/two.tif"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"0")
    assert sorted(r["key"] for r in readers.list_rasters(spark, str(root)).collect()) == ["one.tif", "x/data/two.tif"]
    assert [r["key"] for r in readers.list_rasters(spark, str(root), "x/da").collect()] == ["x/data/two.tif"]


def test_collection_ids_stay_text(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("007", 1), ("2024", 2)], "collection_id string, n int").write.partitionBy("collection_id").parquet(path)
    assert sorted(r["collection_id"] for r in readers.read_index(spark, path).collect()) == ["007", "2024"]
    assert readers.read_index(spark, path, "007").first()["n"] == 1


def test_load_over_several_batches(spark, tmp_path):
    """One collection in several files, one file a batch: every row is kept; another load replaces it."""
    from tessera.streaming import index as SI

    schema = "collection_id string, location string, key string, native_epsg int, seq bigint"
    path = str(tmp_path / "index")

    def load(name, numbers):
        source = str(tmp_path / name)
        spark.createDataFrame([("7", f"/v/{i}", f"{i}", 3857, i) for i in numbers], schema).repartition(3).write.parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = SI.replace_collections(stream, path, str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(int(r["key"]) for r in readers.read_index(spark, path, "7").collect())

    assert load("first", range(10)) == list(range(10))
    assert load("second", range(5, 9)) == [5, 6, 7, 8]


def test_facts_make_each_footprint_once(spark):
    """Footprints still to be computed are computed once for extents and the zoom median together."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def zoom(i):
        made.add(1)
        return float(i % 7)

    box = G.bbox("id", "id", "id + 1", "id + 1")
    fp = spark.range(200).select(
        F.lit("c").alias("collection_id"), F.lit(26916).alias("epsg"), box.alias("b"), zoom("id").alias("native_zoom")
    ).withColumns({"native_ring": G.ring_from_bbox("b"), "web_ring": G.ring_from_bbox("b")})
    row = scan.collection_facts(fp).first()
    assert (row["cog_count"], row["native_zoom"], made.value) == (200, 3, 200)
