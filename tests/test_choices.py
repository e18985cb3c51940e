"""Choices of targets, frames, boxes and lattices on small rows, odd ones included."""

from zonestat.operators import choices as N
from zonestat.operators import mask as M


def test_targets_named_and_filtered(spark):
    kinds = "dataset string, variable string, rule string, places array<string>, days string"
    targets = spark.createDataFrame([("a", "x", "all", None, None), ("b", "y", "nms", None, "30"), ("c", "y", "list", ["own", "p1"], None)], kinds)
    places = spark.createDataFrame([("p1",), ("NMS:1",), ("NMS:1",)], "place_id string")
    rows = lambda **o: sorted(map(tuple, N.select_targets(targets, places, **o).collect()))
    assert rows() == [("a", "x", "NMS:1", "all"), ("a", "x", "p1", "all"), ("b", "y", "NMS:1", "30"), ("c", "y", "own", "all"), ("c", "y", "p1", "all")]
    assert rows(variables=("y",), wanted=("p1",)) == [("c", "y", "p1", "all")]
    assert rows(datasets=("b",), wanted=("q", "q"), named=True, days="7") == [("b", "y", "q", "7")]
    assert rows(datasets=("none",)) == [] and rows(named=True) == []


def test_bounds_without_vertices_keep_the_box(spark):
    places = spark.createDataFrame([("wide", -180.0, 0.0, 180.0, 9.0), ("bare", -180.0, 0.0, 180.0, 9.0), ("small", 1.0, 2.0, 3.0, 4.0)], "place_id string, x0 double, y0 double, x1 double, y1 double")
    vertices = spark.createDataFrame([("wide", 178.0, 1.0), ("wide", -170.0, 5.0), ("wide", float("nan"), None), ("small", 0.0, 0.0)], "place_id string, lon double, lat double")
    assert sorted(map(tuple, N.map_bounds(places, vertices).collect())) == [("bare", -180.0, 0.0, 180.0, 9.0), ("small", 1.0, 2.0, 3.0, 4.0), ("wide", 178.0, 1.0, 190.0, 5.0)]


def test_frames(spark):
    cells = spark.createDataFrame([("a", 179.0), ("a", -179.0), ("b", 10.0), ("b", 350.0), ("c", None)], "place_id string, longitude double")
    assert {r["place_id"]: r["centre"] for r in N.frame_choice(cells).collect()} == {"a": 180, "b": 0, "c": 0}


def test_orders(spark):
    rows = spark.createDataFrame([("p", 2.0, 1.0), ("p", 1.0, 9.0), ("o", 3.0, 0.0)], "place_id string, latitude double, longitude double")
    assert [tuple(r) for r in N.in_order(rows).collect()] == [("o", 3.0, 0.0), ("p", 1.0, 9.0), ("p", 2.0, 1.0)]
    axis = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,), (9.0,)], "v double")
    assert [r["v"] for r in N.axis_table(axis, "v", 1.0, 3.0, descending=True).collect()] == [3.0, 1.0]


def test_lattices(spark):
    kinds = "k int, x0 double, y0 double, dx double, dy double"
    a = spark.createDataFrame([(1, 10.00004, 20.0, 0.04999998, -0.05), (2, 10.02, 20.0, 0.05, -0.05)], kinds)
    assert [(r["k"], r["x0"], r["dx"], r["on_grid"]) for r in N.snap_lattice(a, 0.05).orderBy("k").collect()] == [(1, 10.0, 0.05, True), (2, 10.0, 0.05, False)]
    b = spark.createDataFrame([(1, 10.0, 20.0, 0.05, -0.05), (2, 10.0, 20.0, 0.05, -0.05)], kinds)
    assert {r["k"]: r["same"] for r in N.same_lattice(a, b, "k", 100).collect()} == {1: True, 2: False}


def test_sampled_share_nears_the_exact_one(spark):
    ring = [(0.11, 0.13), (2.63, 0.41), (1.37, 2.71), (0.11, 0.13)]
    edges = M.edges_of(spark, {"p": [[ring]]})
    lon, lat = M.axis(spark, 0.0, 1.0, 4), M.axis(spark, 0.0, 1.0, 4)
    x, y = M.axis_edges(lon), M.axis_edges(lat)
    cells = x.selectExpr("'p' AS place_id", "i", "centre AS lon", "lo AS x_lo", "hi AS x_hi").crossJoin(y.selectExpr("i AS j", "centre AS lat", "lo AS y_lo", "hi AS y_hi"))
    exact = {(r["i"], r["j"]): r["weight"] for r in M.covered_share(edges, cells).collect()}
    got = {(r["i"], r["j"]): r["weight"] for r in N.sampled_share(edges, lon, lat).collect()}
    assert got and all(abs(exact.get(k, 0.0) - got.get(k, 0.0)) < 0.02 for k in exact | got)


def test_external_mean_takes_the_last_value(spark):
    series = spark.createDataFrame([("2020-01-01", 1), ("2020-01-02", 2)], "date string, n int")
    other = spark.createDataFrame([("2020-01-01", 5.0, 1), ("2020-01-01", 6.0, 2), ("2020-01-01", float("nan"), 3), ("2020-01-03", 1.0, 4)], "date string, mean double, ord int")
    assert sorted(map(tuple, N.with_daily_mean(series, other).collect())) == [("2020-01-01", 1, 6.0), ("2020-01-02", 2, None)]
