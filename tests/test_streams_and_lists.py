"""Streams that assemble series in any order, and lists, outcomes and documents on small tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from zonestat.functions import columns as C
from zonestat.operators import catalog as K
from zonestat.operators import choices as N
from zonestat.operators import incremental as I
from zonestat.operators import series as S
from zonestat.operators import stats as A
from zonestat.sources import readers as R
from zonestat.sources import writers as W
from zonestat.streaming import assemble as T

CHUNK = "place_id string, date date, mean double, span_start date, span_end date"


def chunk(place, first, days, shift, late=0):
    """Rows of one chunk: some lie outside of its span."""
    start = dt.date(2026, 1, 1) + dt.timedelta(first)
    end = start + dt.timedelta(days - 1)
    return [(place, start + dt.timedelta(k), 100.0 * shift + k, start, end) for k in range(-2, days + late)]


@pytest.mark.parametrize("seed", range(2))
def test_series_from_chunks_in_any_order(spark, tmp_path, seed):
    chunks = [chunk("p", 0, 40, 1), chunk("p", 30, 40, 2, 3), chunk("p", 60, 20, 3), chunk("p", 30, 41, 4), chunk("q", 5, 10, 5), chunk("q", 0, 12, 6)]
    random.Random(seed).shuffle(chunks)
    landing, out, at = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for k, rows in enumerate(chunks):
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(landing)
        if k % 2:
            T.write_assembled(T.read_chunks(spark, landing, CHUNK), out, at).awaitTermination()
    T.write_assembled(T.read_chunks(spark, landing, CHUNK), out, at).awaitTermination()
    want = I.assemble(spark.createDataFrame([r for rows in chunks for r in rows], CHUNK), {}, by=("place_id",))
    key = lambda df: sorted((r["place_id"], r["date"], r["mean"]) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(want) and want.count() == 80 + 15
    assert {r[0] for r in want.where("place_id = 'q' and date < '2026-01-13'").selectExpr("mean >= 600").collect()} == {True}


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "place_id string, k int, v string")
    T.upsert(rows(("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")), path, ("k",), ("place_id",))
    files = {f.name for f in (tmp_path / "t/place_id=b").glob("*.parquet")}
    T.upsert(rows(("a", 2, "y"), ("c", 9, "z")), path, ("k",), ("place_id",))
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("place_id", "k", "v").collect()) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 9, "z")]
    assert {f.name for f in (tmp_path / "t/place_id=b").glob("*.parquet")} == files
    T.upsert(rows(("a", 1, "x")).drop("place_id"), str(tmp_path / "u"), ("k",), ())
    T.upsert(rows(("a", 1, "w")).drop("place_id"), str(tmp_path / "u"), ("k",), ())
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).collect()] == [(1, "w")]


def test_windows_of_the_record(spark):
    ext = spark.createDataFrame([("long", "2020-01-01", "2026-03-04"), ("short", "2026-03-01", "2026-03-04")], "id string, start string, end string")
    day = lambda days: {r["id"]: (r["start"].isoformat(), r["end"].isoformat()) for r in I.record_windows(ext, days).collect()}
    assert day(30) == {"long": ("2026-02-03", "2026-03-04"), "short": ("2026-03-01", "2026-03-04")}
    assert day(None) == {"long": ("2020-01-01", "2026-03-04"), "short": ("2026-03-01", "2026-03-04")}


def test_outcomes(spark):
    units = spark.createDataFrame([("done", "a"), ("again", "a"), ("wrong", "a"), ("cut", "b"), ("untried", "b"), ("later", "c"), ("healthy", "a")], "unit string, host string")
    attempts = [("done", "a", 1, True, None), ("again", "a", 2, False, "fetch failed"), ("again", "a", 3, True, None), ("wrong", "a", 4, False, "bad axis\nmore"), ("cut", "b", 5, False, "HTTP 502"), ("cut", "b", 6, False, "no response within 60 s")]
    got = {r["unit"]: (r["status"], r["kind"], r["tries"], r["reason"]) for r in K.outcomes(units, spark.createDataFrame(attempts, "unit string, host string, at int, ok boolean, message string")).collect()}
    assert got == {
        "done": ("completed", None, 0, None), "again": ("completed", None, 1, None), "wrong": ("error", None, 0, "bad axis"), "cut": ("skipped", "timeout", 2, "no response within 60 s"),
        "untried": ("skipped", "timeout", 0, "not reached: host still down"), "later": ("deferred", None, 0, None), "healthy": ("deferred", None, 0, None),
    }
    kinds = spark.createDataFrame([("HTTP 503",), ("HTTP 404",), ("read timed out",), ("ECONNRESET",), ("anything",)], "m string").select(K.failure_kind(F.col("m"))).collect()
    assert [r[0] for r in kinds] == ["5xx", None, "timeout", "network", None]


def test_curated_order_and_lists(spark):
    rows = [("b", "x2", "beta"), ("b", "x1", "beta"), ("b", "x3", "alpha"), ("z", "z1", "zed"), ("a", "a1", "any"), ("n", "n1", "noise"), ("u", "u1", "unlisted")]
    places = spark.createDataFrame(rows, "collection string, place_id string, name string")
    manifest = spark.createDataFrame([("a", 2), ("z", 1), ("b", 3), ("n", 0)], "slug string, rank int")
    ranked = K.group_ranks(places, manifest, ("b", "n", "missing"), folded=("n",))
    got = K.sections(ranked, 2).collect()
    assert [(r["collection"], r["place_id"], r["more"]) for r in got] == [("b", "x3", 1), ("b", "x1", 1), ("n", "n1", 0), ("z", "z1", 0), ("a", "a1", 0), ("u", "u1", 0)]
    assert {r["collection"] for r in got if r["shown"]} == {"b"}
    assert [r["place_id"] for r in K.by_name(places).collect()] == ["x3", "a1", "x1", "x2", "n1", "u1", "z1"]


def test_datasets_are_resolved_without_comparing_all(spark):
    reg = spark.createDataFrame([("erddap/Sst", "SST", False), ("other", "sst", False), ("sst2", "x", True)], "id string, dataset_id string, pending boolean")
    asked = spark.createDataFrame([("sst",), ("OTHER",), ("erddap/Sst",), ("sst2",)], "wanted string")
    found = K.resolve_datasets(reg, asked)
    assert {(r["wanted"], r["id"], r["how"]) for r in found.collect()} == {("sst", "erddap/Sst", 3), ("OTHER", "other", 2), ("erddap/Sst", "erddap/Sst", 1)}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_and_spans(spark):
    row = spark.range(1).select(
        C.result_name("stats", "csv", F.lit("A:1 b"), F.lit(None).cast("string"), F.lit(""), F.lit("2026-01-01")).alias("a"), C.lobe_span(F.lit(-170.0), F.lit(-160.0), F.lit(0.0), F.lit(359.75)).alias("b"),
        C.lobe_span(F.lit(170.0), F.lit(180.0), F.lit(-179.875), F.lit(179.75)).alias("c"), C.lobe_span(F.lit(-10.0), F.lit(10.0), F.lit(0.0), F.lit(360.0)).alias("d"),
    ).first()
    assert row["a"] == "stats_A-1-b_2026-01-01.csv"
    assert [tuple(row[c]) for c in "bcd"] == [(190.0, 200.0), (170.0, 179.75), (10.0, 350.0)]


def test_cells_as_squares_and_points(spark):
    cells = spark.createDataFrame([(179.75, 10.0, 1.0), (-179.75, 10.0, float("nan")), (179.25, 10.0, None)], "longitude double, latitude double, value double")
    squares = {round(r["longitude"], 2): r for r in W.cell_squares(cells, centre=None).collect()}
    assert sorted(squares) == [179.25, 179.75, 180.25] and squares[180.25]["value"] is None
    ring = squares[180.25]["geometry"]["coordinates"][0]
    assert [tuple(p) for p in ring][:3] == [(180.0, 9.75), (180.5, 9.75), (180.5, 10.25)]  # one row of cells: the other axis's step
    points = {r["geometry"]["coordinates"][0] for r in W.cell_points(cells).collect()}
    assert points == {179.25, 179.75, 180.25}


def test_lattices(spark):
    rasters = spark.createDataFrame([("p", 4, 2, -81.0, 24.0, -80.0, 25.0)], "place_id string, width int, height int, west double, south double, east double, north double")
    axes = N.lattice_axes(rasters).orderBy("axis", "k").collect()
    assert [r["centre"] for r in axes] == [24.75, 24.25, -80.875, -80.625, -80.375, -80.125]
    cells = spark.createDataFrame([("p", r.centre, 24.25, 0.5) for r in axes if r.axis == "lon"] + [("p", -79.0, 24.5, 1.0), ("p", -80.5, 25.01, 1.0)], "place_id string, longitude double, latitude double, weight double")
    assert sorted((r["row"], r["col"]) for r in N.on_lattice(cells, rasters).collect()) == [(1, 0), (1, 1), (1, 2), (1, 3)]


def test_anomalies_on_other_lattices_are_refused(spark):
    cube = spark.createDataFrame([("p", 2026, 5, 0, 0, 3.0)], "place_id string, year int, band int, row int, col int, value double")
    clim = spark.createDataFrame([("p", 5, 0, 0, 1.0)], "place_id string, band int, row int, col int, mean double")
    at = lambda x: spark.createDataFrame([("p", x, 25.0, 0.05, -0.05)], "place_id string, x0 double, y0 double, dx double, dy double")
    assert S.anomaly(cube, clim, (at(-81.0), at(-81.0001))).first()["anom"] == 2.0
    with pytest.raises(Exception, match="lattices differ"):
        S.anomaly(cube, clim, (at(-81.0), at(-81.01))).collect()


def test_then_line_has_one_row_for_each_band(spark):
    rows = spark.createDataFrame([(y, b, 1.0 * y, 7.0 + b) for y in (2001, 2002) for b in (1, 2)] + [(2001, 3, 1.0, None)], "year int, band int, value double, clim double")
    assert sorted((r["band"], r["clim"], r["line"]) for r in S.then_line(rows).collect()) == [(1, 8.0, "clim"), (2, 9.0, "clim")]


def test_collections(spark):
    items = [("i1", "c", "p", "d", "v", "2026-01-01", "2026-02-01", 170.0, 0.0, 180.0, 5.0, "complete"), ("i2", "c", "q", "d", "w", "2025-01-01", "2026-01-01", -180.0, 1.0, -175.0, 6.0, "partial")]
    made = spark.createDataFrame(items, "id string, collection string, place_id string, dataset_id string, variable string, start string, end string, west double, south double, east double, north double, status string")
    planned = spark.createDataFrame([("c", "i1"), ("c", "i3"), ("c", "i3")], "collection string, id string")
    body = json.loads(W.collections(made, planned).first()["body"])
    assert body["extent"] == {"spatial": {"bbox": [[170.0, 0.0, -175.0, 6.0]]}, "temporal": {"interval": [["2025-01-01T00:00:00Z", "2026-02-01T00:00:00Z"]]}}
    assert body["item_counts"] == {"complete": 1, "partial": 1, "pending": 1} and body["summaries"]["variable"] == ["v", "w"]
    assert sorted(r["href"] for r in W.item_links(made).collect()) == ["./items/i1.json", "./items/i2.json"]


def test_lobes_and_classes(spark, tmp_path):
    mask = lambda *r: spark.createDataFrame(list(r), "latitude double, longitude double, weight double")
    got = A.joined_lobes(mask((1.0, 180.0, 0.5), (2.0, 180.0, 1.0)), mask((1.0, 180.0, 0.25), (1.0, -179.0, 1.0)))
    assert sorted(tuple(r) for r in got.collect()) == [(1.0, -179.0, 1.0), (1.0, 180.0, 0.5), (2.0, 180.0, 1.0)]
    classes = spark.createDataFrame([(0.5, 50.0)], "fraction double, percent_cells double")
    assert A.published(classes).columns == ["frac_area", "pct_cells"] and A.as_queried(A.published(classes)).columns == classes.columns
    got.write.parquet(str(tmp_path / "m"))
    assert R.row_count(spark, str(tmp_path / "m")) == 3
