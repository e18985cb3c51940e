"""Request URLs, readers, sinks, catalog operators and the stream."""

import json

from pyspark.sql import functions as F

from zonestat.operators import catalog as K
from zonestat.sources import readers, requests, writers


def test_grid_urls():
    r = requests.GridRequest("https://e.org/erddap/", "sst", "CRW_SST", ("2026-01-01T12:00:00Z", "2026-01-30T12:00:00Z"), (20.0, 21.5), (-160.5, -159.0))
    want = "https://e.org/erddap/griddap/sst.parquet?CRW_SST%5B(2026-01-01T12:00:00Z):1:(2026-01-30T12:00:00Z)%5D%5B(21.5):1:(20.0)%5D%5B(-160.5):1:(-159.0)%5D"
    assert r.url() == want
    assert "%5B(x):1:(x)%5D" in requests.slice_url(r, "x")
    assert len(requests.lobe_urls(r, [(1, 2, 3, 4), (5, 6, 7, 8)])) == 2
    assert [requests.pick_format(f, c) for f, c in ((["csv"], True), ([], True), (["parquet", "parquetWMeta"], True), (["parquet"], False))] == ["csvp", "parquet", "parquetWMeta", "jsonp"]


def test_table_urls():
    c = requests.place_constraints((-121, 33, -120, 34), "2015-01-01", "2015-02-01", "measurement_type", "t")
    url = requests.TableRequest("https://e.org/erddap", "cast", ["longitude", "latitude"], c, ["distinct()"]).url()
    assert url.startswith("https://e.org/erddap/tabledap/cast.parquetWMeta?longitude%2Clatitude&time%3E=2015-01-01T00:00:00Z&time%3C=2015-02-01T23:59:59Z&longitude%3E=-121")
    assert url.endswith("&measurement_type=%22t%22&distinct()")


def test_csv_with_units(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time (UTC),sst (degree_C),name\n2026-01-01,NaN,"a, ""b"""\n2026-01-02,,c\n2026-01-03,1.5,d\n')
    rows = readers.csv_with_units(spark, str(tmp_path / "a.csv"), ("sst",)).orderBy("time").collect()
    assert [r["sst"] for r in rows] == [None, None, 1.5] and rows[0]["name"] == 'a, "b"'


def test_json_table_and_registry(spark):
    doc = {"table": {"columnNames": ["a", "b"], "rows": [["1", None], ["2", "x"]]}}
    got = readers.json_table(spark.createDataFrame([(json.dumps(doc),)], "d string"), "d", ["a", "b"])
    assert sorted(map(tuple, got.collect()), key=str) == [("1", None), ("2", "x")]
    docs = [json.dumps({"id": "x", "erddap:dataset_id": "X", "cube:variables": {"sst": {"unit": "K"}}}), "{broken"]
    reg = readers.registry(spark.createDataFrame([(d,) for d in docs], "body string")).collect()
    assert len(reg) == 1 and reg[0]["protocol"] == "griddap" and reg[0]["variables"]["sst"]["unit"] == "K"


def test_series_sink_prunes(spark, tmp_path):
    rows = [(f"p{k}", "d", "v", d, float(k)) for k in range(3) for d in ("2026-01-01", "2026-01-02")]
    df = spark.createDataFrame(rows, "place_id string, dataset_id string, variable string, d string, mean double").withColumn("date", F.col("d").cast("date")).drop("d")
    writers.write_series(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.where("place_id = 'p1'").count() == 2 and back.count() == 6
    writers.export_csv(df, str(tmp_path / "c"))
    writers.export_parquet(df, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.parquet(str(tmp_path / "e")).count() == 6


def test_features_and_items(spark):
    cells = spark.createDataFrame([(89.99, 10.0, None)], "latitude double, longitude double, value double")
    line = json.loads(writers.features(writers.cell_squares(cells, 0.1, 0.1), F.col("geometry"), ["longitude"]).first()["value"])
    assert line["geometry"]["coordinates"][0][2][1] == 90.0 and line["properties"]["longitude"] == 10.0
    row = spark.sql("SELECT 'i' id, 'p' place_id, 'd' dataset_id, 'v' variable, date'2026-01-01' start, date'2026-01-02' end, 1D west, 2D south, 3D east, 4D north, 'h' href")
    body = json.loads(writers.items(row).first()["body"])
    assert body["properties"]["start_datetime"] == "2026-01-01T00:00:00Z" and body["assets"]["series"]["href"] == "h"
    assert json.loads(writers.geoparquet_footer("geometry", (0, 0, 1, 1), ["Polygon"])["geo"])["version"] == "1.1.0"


def test_catalog_operators(spark):
    overlay = spark.createDataFrame([(" a ", "x"), ("zz", "y")], "k string, s string")
    rows = spark.createDataFrame([("a", "old"), ("b", "old")], "k string, s string")
    assert sorted(map(tuple, K.overlay_status(rows, overlay, "k", ["s"]).collect())) == [("a", "x"), ("b", "old")]
    assert [r["k"] for r in K.overlay_unmatched(rows, overlay, "k").collect()] == ["zz"]
    assert K.overlay_repeats(overlay.union(overlay), "k").count() == 2
    reg = spark.createDataFrame([("erddap/Sst", "SST", False), ("other", "sst2", True)], "id string, dataset_id string, pending boolean")
    asked = spark.createDataFrame([("sst",), ("erddap/Sst",), ("sst2",)], "wanted string")
    assert {(r["wanted"], r["how"]) for r in K.resolve_datasets(reg, asked).collect()} == {("sst", 3), ("erddap/Sst", 1)}
    places = spark.createDataFrame([("Monterey", 1.0), ("monterey bay", 5.0), ("North Monterey", 2.0), ("xmontereyx", 9.0), ("no", 1.0)], "name string, area_km2 double")
    assert [r["match"] for r in K.rank_matches(places, "Monterey").collect()] == [1, 2, 3, 4]
    now = spark.createDataFrame([("a", 0, "2", 1, None, None), ("b", 0, None, 1, None, None), ("c", 0, None, 1, "s", None)], "slug string, ordinal int, edited string, count int, checksum string, etag string")
    was = spark.createDataFrame([("a", 0, "1", 1, None, None), ("c", 0, None, 1, "s", None)], now.schema)
    assert {r["slug"]: r["reason"] for r in K.source_changes(now, was).collect()} == {"a": "edited", "b": "new", "c": None}


def test_stream_equals_batch(spark, tmp_path):
    from zonestat.operators.stats import stats_daily
    from zonestat.streaming.daily import read_slabs, stream_daily

    slab = spark.sql("SELECT timestampadd(HOUR, id * 5, timestamp'2026-01-01 00:00:00') AS time, float(20.0) AS latitude, float(-160 + 0.05 * (id % 3)) AS longitude, float(id) AS value FROM range(40)")
    slab.write.parquet(str(tmp_path / "in"))
    mask = spark.createDataFrame([(20.0, -160.0, 1.0), (20.0, -159.95, 0.5)], "latitude double, longitude double, weight double")
    q = stream_daily(read_slabs(spark, str(tmp_path / "in")), mask, F.col("value").cast("double")).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r["date"], r["n"], round(r["mean_wt"], 9)) for r in spark.table("days").collect()}
    finally:
        q.stop()
    want = {(r["date"], r["n"], round(r["mean_wt"], 9)) for r in stats_daily(slab, mask, F.col("value").cast("double")).collect()}
    assert got == want and want


def test_masks_of_many_places_are_few_files(spark, sf, tmp_path, monkeypatch):
    from zonestat.plans import queries as Q

    monkeypatch.setattr(Q, "fresh_path", lambda spark, kind: f"file://{tmp_path}/{kind}")
    n = Q.QUERIES["masks_of_lobes"](spark, sf).count()
    files = list((tmp_path / "mask").rglob("*.csv"))
    assert files and not [f for f in files if f.parent != tmp_path / "mask"]  # no folder for a place
    held = readers.mask_csv(spark, f"file://{tmp_path}/mask", keyed=True)
    assert held.columns == ["place_id", "latitude", "longitude", "weight"]
    assert 0 < held.select("place_id").distinct().count() <= n and not held.where("place_id is null or latitude is null or weight <> 0.5").count()
