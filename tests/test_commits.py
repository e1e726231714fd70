"""What holds when jobs fail, run late, twice or at once: generations, index loads, catalog documents, static lake plans."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import catalog as K
from tessera.plans import refresh
from tessera.sinks import generations, writers
from tessera.sources import files, readers
from tessera.streaming import index as SI
from tessera.streaming import telemetry as ST

# --- incremental index load -------------------------------------------------------------------

ROWS = "collection_id string, native_epsg int, key string, location string, seq bigint, load string"


def load(spark, tmp_path, batches, schema=ROWS):
    """The table after one micro-batch for each list of rows."""
    source, path = tmp_path / "in", str(tmp_path / "table")
    source.mkdir(exist_ok=True)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    for i, rows in enumerate(batches):
        text = "\n".join(json.dumps(r) for r in rows)
        (source / f"{time.time_ns()}-{i}.json").write_text(text)
        SI.replace_collections(raw, path, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["collection_id"], r["key"], r["seq"]) for r in readers.read_index(spark, path).collect())


def scan(collection, number, keys, seq=0):
    return [{"collection_id": collection, "native_epsg": 26916, "key": k, "location": f"/v/{k}", "seq": seq, "load": str(number)} for k in keys]


def test_a_late_old_load_changes_nothing(spark, tmp_path):
    new = scan("a", 10, [f"k{i}" for i in range(10)])
    old = scan("a", 9, ["k0", "gone"])  # as text, "9" sorts above "10"
    want = [("a", f"k{i}", 0) for i in range(10)]
    assert load(spark, tmp_path, [new, old]) == want
    path = str(tmp_path / "table")
    assert SI.remove_superseded(spark, path) == 1 and SI.remove_superseded(spark, path) == 0
    assert readers.read_index(spark, path).count() == 10


def test_a_rescan_drops_vanished_rasters(spark, tmp_path):
    first = scan("007", 1, ["x", "y", "z"]) + scan("b", 1, ["p"])
    again = scan("007", 2, ["x", "w"])
    assert load(spark, tmp_path, [first, again]) == [("007", "w", 0), ("007", "x", 0), ("b", "p", 0)]


def test_order_and_repetition_of_batches(spark, tmp_path):
    parts = [scan("a", 2, ["k1", "k2"], 1), scan("a", 1, ["k9"]), scan("a", 2, ["k2", "k3"], 2), scan("b", 5, ["q"]), scan("a", 2, ["k1", "k2"], 1)]
    want = [("a", "k1", 1), ("a", "k2", 2), ("a", "k3", 2), ("b", "q", 0)]
    for n, order in enumerate(([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 2, 0, 3, 1])):
        folder = tmp_path / str(n)
        folder.mkdir()
        assert load(spark, folder, [parts[i] for i in order]) == want


def test_loads_by_time_and_bad_loads(spark, tmp_path):
    early, late = scan("a", "2024-05-01T10:00:00Z", ["x"]), scan("a", "2024-05-01T09:30:00Z", ["y"])
    assert load(spark, tmp_path, [early, late]) == [("a", "x", 0)]
    other = tmp_path / "other"
    other.mkdir()
    with pytest.raises(Exception, match="not a load number or time"):
        load(spark, other, [scan("a", "scan-9", ["x"])])


# --- generations ------------------------------------------------------------------------------


def lake_rows(spark):
    return spark.range(400).select(
        F.lit("naip").alias("collection"), F.expr("element_at(array('wa', 'or', 'id'), cast(id % 3 + 1 as int))").alias("region"),
        F.expr("cast(2015 + id % 4 as int)").alias("year"), F.lit("b").alias("source_bucket"), F.expr("concat('k/', id, '.tif')").alias("source_key"),
        F.expr("cast(26910 + id % 2 as int)").alias("proj_epsg"), G.bbox("-100 + id * 0.01", "30", "-99.9 + id * 0.01", "30.1").alias("bbox"),
    )


TEMPLATE = "s3://footprints/region={state}/year={year}/data_0.parquet"


@pytest.fixture
def published(spark, tmp_path):
    lake, target, catalog = f"{tmp_path}/lake", f"{tmp_path}/target", f"{tmp_path}/catalog.json"
    lake_rows(spark).write.partitionBy("collection", "region", "year").parquet(lake)
    refresh.refresh(spark, '{"wa": 2016}', lake, target, TEMPLATE, catalog_path=catalog)
    return lake, target, catalog


def ids(catalog):
    return sorted(r["id"] for r in catalog.select("id").collect())


@pytest.mark.parametrize("step", ["index", "document", "pointer", "copy"])
def test_a_failure_at_any_step_leaves_the_old_pair(spark, published, monkeypatch, step):
    lake, target, catalog = published
    before = open(catalog).read()

    def fail(*_args, **_kwargs):
        raise OSError("disk gone")

    place = {
        "index": (writers, "write_staged_index"), "document": (writers, "write_catalog"), "pointer": (generations.files, "write_text"), "copy": (files, "copy_over"),
    }[step]
    with monkeypatch.context() as m:
        m.setattr(*place, fail)
        with pytest.raises(OSError, match="disk gone"):
            refresh.refresh(spark, '{"or": 2017}', lake, target, TEMPLATE, catalog_path=catalog)
    index, documents = refresh.read_published(spark, target)
    assert ids(documents) == ["naip-wa-2016"] and {r["region"] for r in index.select("region").distinct().collect()} == {"wa"}
    assert open(catalog).read() == before
    assert len([n for n in files.children(spark, target) if n.startswith("generation=")]) == 1
    refresh.refresh(spark, '{"or": 2017}', lake, target, TEMPLATE, catalog_path=catalog)
    index, documents = refresh.read_published(spark, target)
    assert ids(documents) == ["naip-or-2017"] and {r["region"] for r in index.select("region").distinct().collect()} == {"or"}
    assert [c["id"] for c in json.loads(open(catalog).read())["collections"]] == ["naip-or-2017"]


def test_one_publication_at_a_time(spark, tmp_path):
    root = f"{tmp_path}/gen"

    def nested(_written):
        generations.publish_generation(spark.range(3), root)

    with pytest.raises(RuntimeError, match="another publication"):
        generations.publish_generation(spark.range(5), root, validate=nested)
    first = generations.publish_generation(spark.range(5), root)
    files.write_text(spark, f"{root}/{generations.LEASE}", f"someone {time.time() - 100}")
    with pytest.raises(RuntimeError, match="another publication"):
        generations.publish_generation(spark.range(7), root)
    assert generations.current_generation(spark, root) == first
    generations.publish_generation(spark.range(7), root, lease_seconds=50)  # its holder is gone
    assert generations.read_generation(spark, root).count() == 7
    assert not files.exists(spark, f"{root}/{generations.LEASE}")


def test_a_tile_index_that_cannot_move_in_leaves_the_old_one(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/index"
    rows = spark.createDataFrame([("a", 26916, "k1"), ("b", 26916, "k2")], "collection_id string, native_epsg int, key string")
    writers.write_tile_index(rows, path)
    move = files.move

    def fail(s, source, target):
        if "_draft" in source:
            raise OSError("no")
        move(s, source, target)

    with monkeypatch.context() as m:
        m.setattr(files, "move", fail)
        with pytest.raises(OSError):
            writers.write_tile_index(rows.withColumn("key", F.lit("new")), path)
    assert sorted(r["key"] for r in readers.read_index(spark, path).collect()) == ["k1", "k2"]
    move(spark, f"{path}/collection_id=a", f"{tmp_path}/aside-a")  # a crash between the two moves
    files.make_folder(spark, f"{path}/_replaced")
    move(spark, f"{tmp_path}/aside-a", f"{path}/_replaced/collection_id=a")
    writers.write_tile_index(rows.where("collection_id = 'b'").withColumn("key", F.lit("new")), path)
    assert sorted(r["key"] for r in readers.read_index(spark, path).collect()) == ["k1", "new"]


# --- catalog documents ------------------------------------------------------------------------


def entry(spark, **fields):
    names = ", ".join(f"{k} {t}" for k, (t, _) in fields.items())
    row = spark.createDataFrame([tuple(v for _, v in fields.values())], names)
    return K.untyped(row, F.lit(0).cast("bigint"), present=("extent_3857",))


def test_header_keys_and_nulls_of_an_upsert(spark, tmp_path):
    path = f"{tmp_path}/catalog.json"
    with open(path, "w") as out:
        json.dump({"version": 1, "title": "Ours", "links": [{"rel": "self"}], "collections": [{"id": "a", "extent_3857": [1, 2, 3, 4], "note": "x", "label": "A"}], "owner": None}, out)
    writers.upsert_catalog_document(entry(spark, id=("string", "a"), extent_3857=("array<int>", None), label=("string", None)), path)
    doc = json.loads(open(path).read())
    assert doc["title"] == "Ours" and doc["links"] == [{"rel": "self"}] and "owner" in doc and doc["version"] == 1
    assert doc["collections"] == [{"id": "a", "extent_3857": None, "note": "x", "label": "A"}]


def test_an_unreadable_document_is_not_overwritten(spark, tmp_path):
    path = f"{tmp_path}/catalog.json"
    with open(path, "w") as out:
        out.write('{"version": 1, "collections": [{"id": "a"')
    with pytest.raises(ValueError, match="not a catalog document"):
        writers.upsert_catalog_document(entry(spark, id=("string", "b")), path)
    assert open(path).read().endswith('"a"')


def test_deleting_a_collection_everywhere(spark, tmp_path):
    catalog, table, index = f"{tmp_path}/catalog.json", f"{tmp_path}/table", f"{tmp_path}/index"
    rows = spark.createDataFrame([("a", 26916, "k1"), ("a", 26917, "k2"), ("b", 26916, "k3")], "collection_id string, native_epsg int, key string")
    for c in "ab":
        writers.replace_collection(rows, table, c)
    writers.write_tile_index(rows, index)
    with open(catalog, "w") as out:
        json.dump({"version": 1, "title": "Ours", "collections": [{"id": "a"}, {"id": "b"}]}, out)
    with pytest.raises(ValueError, match="not found"):
        writers.delete_collection_everywhere(spark, "zz", catalog, table, index)
    assert writers.delete_collection_everywhere(spark, "a", catalog, table, index) == 2
    doc = json.loads(open(catalog).read())
    assert doc["title"] == "Ours" and [c["id"] for c in doc["collections"]] == ["b"]
    assert [r["key"] for r in readers.read_index(spark, table).collect()] == [r["key"] for r in readers.read_index(spark, index).collect()] == ["k3"]


# --- static lake plan -------------------------------------------------------------------------


def files_read(df):
    """Files that the scans of a collected plan opened."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_only_selected_folders_are_opened(spark, tmp_path):
    lake = f"{tmp_path}/lake"
    lake_rows(spark).repartition(1).write.partitionBy("collection", "region", "year").parquet(lake)
    chosen = readers.read_selections(spark, '{"wa": 2016, "or": 2016, "id": 2018}')
    got = readers.read_selected(spark, lake, chosen)
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()
    found = got.groupBy().count()  # warm listing
    assert found.first()[0] == lake_rows(spark).where("(region in ('wa', 'or') and year = 2016) or (region = 'id' and year = 2018)").count()
    got.collect()
    assert files_read(got) == 3


def test_addresses_are_read_by_one_scan(spark, tmp_path):
    lake, apart = f"{tmp_path}/lake", f"{tmp_path}/own + odd%20name"
    rows = lake_rows(spark)
    rows.repartition(1).write.partitionBy("collection", "region", "year").parquet(lake)
    rows.where("region = 'wa' and year = 2015").withColumn("extra", F.lit(7)).drop("region", "year").write.parquet(f"{apart}/a")
    rows.where("region = 'or' and year = 2018").drop("region", "year").repartition(2).write.parquet(f"{apart}/b")
    uris = [{"state": "wa", "year": 2015, "uri": f"{apart}/a"}, {"state": "or", "year": 2018, "uri": f"{apart}/b"}, {"state": "id", "year": 2018, "uri": f"{apart}/b"}, {"state": "id", "year": 2016}]
    got = readers.read_selected(spark, lake, readers.read_selections(spark, json.dumps(uris)))
    counts = {(r["region"], r["year"]): r["count"] for r in got.groupBy("region", "year").count().collect()}
    n = {(r["region"], r["year"]): r["count"] for r in rows.groupBy("region", "year").count().collect()}
    assert counts == {("wa", 2015): n["wa", 2015], ("or", 2018): n["or", 2018], ("id", 2018): n["or", 2018], ("id", 2016): n["id", 2016]}
    assert got.where("extra = 7").count() == n["wa", 2015]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2  # the lake and one scan over all addresses


# --- exact percentiles of a trailing hour -----------------------------------------------------


def test_trailing_percentiles_and_freed_state(spark, tmp_path):
    """Several batches, late requests within the watermark, a repeated folder and compaction; old panes leave the state."""
    schema = "ts timestamp, args string, upstream_time_s string"
    source, path = tmp_path / "in", str(tmp_path / "panes")
    source.mkdir()
    rng = random.Random(4)
    told, sizes = [], []

    def batch(i, minutes):
        rows = [(m * 60 + rng.randrange(60), rng.choice(["0.1", "0.25", "1.5", "-", f"0.{rng.randrange(999):03}"])) for m in minutes for _ in range(20)]
        told.extend(rows)
        (source / f"{i}.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T{t // 3600:02}:{t // 60 % 60:02}:{t % 60:02}Z", "args": "REQUEST=GetMap", "upstream_time_s": v}) for t, v in rows))
        raw = spark.readStream.schema(schema).json(str(source))
        query = ST.panes_to(raw, path, str(tmp_path / "checkpoint"), slide="5 minutes", late="10 minutes").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    batch(0, range(0, 30))
    batch(1, range(22, 60))  # some of the first batch's panes again
    batch(2, range(60, 90))
    batch(3, range(300, 302))
    batch(4, range(302, 303))
    assert sizes[-1] < 60 < max(sizes)  # only the panes of the last minutes are left
    store = ST.pane_store(path)

    def check():
        got = {r["window_start"].timestamp(): r for r in ST.trailing_latency(store.current(spark)).collect()}
        base = 1704067200
        want = {}
        for t, v in told:
            for back in range(12):
                want.setdefault(base + t // 300 * 300 - back * 300, []).append(0.0 if v == "-" else float(v))
        assert got.keys() == want.keys()
        for start, values in want.items():
            values.sort()
            r, n = got[start], len(values)
            assert (r["n"], r["min"], r["max"]) == (n, values[0], values[-1]) and r["mean"] == pytest.approx(sum(values) / n)
            assert (r["median"], r["p95"], r["p99"]) == tuple(values[min(n - 1, int(n * p))] for p in (0.5, 0.95, 0.99))

    check()
    store.compact(spark)
    check()
