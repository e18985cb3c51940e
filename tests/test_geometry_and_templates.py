import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from zonestat.functions import geometry as G
from zonestat.operators import stats as A
from zonestat.plans.templates import run_template

RING = "ring array<struct<x: double, y: double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(w, s, e, n, clockwise=False):
    points = [(w, s), (e, s), (e, n), (w, n), (w, s)]
    return ring(*(points[::-1] if clockwise else points))


def test_geojson(spark):
    texts = ['{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}', '{"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}', '{"type": "Point", "coordinates": [1, 2]}']
    got = spark.createDataFrame(list(enumerate(texts)), "k int, g string").select("k", G.geojson_parts(F.col("g")).alias("p")).orderBy("k").collect()
    assert [len(r["p"]) if r["p"] else 0 for r in got] == [1, 2, 0]
    assert (got[1]["p"][1][0][2]["x"], got[1]["p"][1][0][2]["y"]) == (6.0, 6.0)


def test_turn_and_snap(spark):
    df = spark.createDataFrame([(square(0, 0, 2, 3),), (square(0, 0, 2, 3, True),)], RING)
    assert sorted(r[0] for r in df.select(G.ring_turn(F.col("ring"))).collect()) == [-12.0, 12.0]
    assert all(r[0] < 0 for r in df.select(G.ring_turn(G.counter_clockwise(F.col("ring")))).collect())
    near = spark.createDataFrame([(ring((179.99995, 0), (-179.99999, 1), (170, 2)),)], RING).select(G.snapped(F.col("ring"))).first()[0]
    assert [p["x"] for p in near] == [180.0, -180.0, 170.0]


def area(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:]))) / 2


def band_share(points, west, east):
    """A ring's area between two meridians, by cutting it at both; by force, on lists."""
    for at, keep in ((west, lambda x: x >= west), (east, lambda x: x <= east)):
        out = []
        for a, b in zip(points, points[1:]):
            if keep(a[0]) != keep(b[0]):
                out.append((at, a[1] + (at - a[0]) * (b[1] - a[1]) / (b[0] - a[0])))
            if keep(b[0]):
                out.append(b)
        points = [*out, out[0]] if out else []
    return area(points) if points else 0.0


def folded(points):
    return [((x + 180) % 360 - 180, y) for x, y in points]


def test_split(spark):
    """Random rings about the antimeridian: each side has the area that the unfolded ring has there, and nothing leaves the globe."""
    rng = random.Random(41)
    rings, want = [], {}
    for k in range(60):
        n, cx, cy, r = rng.randrange(3, 14), rng.choice((-180.0, 180.0, 177.0, 20.0)) + rng.uniform(-6, 6), rng.uniform(-60, 60), rng.uniform(1, 12)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        plain = [(cx + r * rng.uniform(0.4, 1) * math.cos(t), cy + r * math.sin(t)) for t in turns]
        plain = [*plain, plain[0]]
        rings.append((k, ring(*folded(plain))))
        want[k] = {w: s for w in (-2, -1, 0, 1) if (s := band_share(plain, -180 + 360 * w, 180 + 360 * w)) > 1e-6}
    df = spark.createDataFrame(rings, f"id int, {RING}")
    got = {}
    for r in G.split_at_antimeridian(df, ["id"]).collect():
        points = [(p["x"], p["y"]) for p in r["ring"]]
        assert points[0] == points[-1] and all(-180 <= x <= 180 for x, _ in points)
        got.setdefault(r["id"], []).append(area(points))
    assert sum(len(w) > 1 for w in want.values()) > 20
    for k, w in want.items():
        assert sorted(s for s in got.get(k, []) if s > 1e-6) == pytest.approx(sorted(w.values()), rel=1e-9, abs=1e-6)
    jumps = {r["id"]: r["jump"] for r in G.widest_jump(df, ["id"]).collect()}
    for k, points in rings:
        assert jumps[k] == pytest.approx(max(abs(a["x"] - b["x"]) for a, b in zip(points, points[1:])))
    pole = spark.createDataFrame([(0, ring(*[(-180 + 60 * k, 80) for k in range(6)], (-180, 80)))], f"id int, {RING}")
    with pytest.raises(Exception, match="pole"):
        G.split_at_antimeridian(pole, ["id"]).collect()


def test_holes_go_with_their_shells(spark):
    """A shell that jumps and a hole that doesn't: the hole comes to the pieces of its shell."""
    rows = [("f", 0, ring((165, 0), (-165, 0), (-165, 20), (165, 20), (165, 0))), ("f", 1, ring((-175, 5), (-170, 5), (-170, 9), (-175, 9), (-175, 5)))]
    vertices = G.vertices_of(spark.createDataFrame(rows, f"f string, r int, {RING}"), ["f", "r"])
    pieces = {(r["r"], r["world"]): sorted({p["x"] for p in r["ring"]}) for r in G.rings_from(G.split_vertices(vertices, ["f", "r"], shell="r"), ["f", "r", "world"]).collect()}
    assert pieces == {(0, 0): [165.0, 180.0], (0, 1): [-180.0, -165.0], (1, 1): [-175.0, -170.0]}


def test_a_long_ring_splits_in_linear_work(spark):
    import time

    import pandas as pd

    n = 60_000
    t = [2 * math.pi * k / n for k in range(n)] + [0.0]
    xy = [(180 + 9 * (1 + 0.1 * math.sin(50 * a)) * math.cos(a), 9 * math.sin(a)) for a in t]
    frame = pd.DataFrame({"id": 1, "k": range(n + 1), "x": [(x + 180) % 360 - 180 for x, _ in xy], "y": [y for _, y in xy]})
    vertices = spark.createDataFrame(frame, "id int, k int, x double, y double").cache()
    vertices.count()
    began = time.perf_counter()
    rows = G.split_vertices(vertices, ["id"]).collect()
    assert time.perf_counter() - began < 20
    sides = {w: area([(r["x"], r["y"]) for r in sorted((r for r in rows if r["world"] == w), key=lambda r: r["k"])]) for w in {r["world"] for r in rows}}
    assert sum(sides.values()) == pytest.approx(area(xy), rel=1e-9) and min(sides.values()) > 50


def test_nesting(spark):
    rows = [("f", 0, square(0, 0, 10, 10, True)), ("f", 1, square(1, 1, 9, 9)), ("f", 2, square(2, 2, 4, 4, True)), ("f", 3, square(2.5, 2.5, 3, 3)), ("f", 4, square(50, 50, 51, 51)), ("g", 5, square(1, 1, 2, 2)), ("f", 6, square(0, 0, 0.5, 0.5))]
    nested = G.nested_rings(spark.createDataFrame(rows, f"feature string, k int, {RING}"))
    got = {(r["feature"], r["part"], r["ring_no"]) for r in nested.collect()}
    assert got == {("f", 0, 0), ("f", 0, 1), ("f", 0, 2), ("f", 2, 0), ("f", 2, 1), ("f", 4, 0), ("g", 5, 0)}
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_holes_in_one_feature(spark):
    """A grid of shells, each inside a hole of a larger one, by force."""
    rows, want, k = [], {}, 0
    for x in range(20):
        for y in range(20):
            for depth, clockwise in ((0, True), (0.2, False), (0.3, True), (0.4, False)):
                rows.append(("f", k, square(x + depth, y + depth, x + 1 - depth - 0.01, y + 1 - depth - 0.01, clockwise)))
                want[k] = k if clockwise else k - 1
                k += 1
    got = G.nested_rings(spark.createDataFrame(rows, f"feature string, k int, {RING}")).collect()
    by_corner = {(r[2][0]["x"], r[2][0]["y"], len({p["x"] for p in r[2]})): r[1] for r in rows}
    assert len(got) == len(rows) and len(by_corner) == len(rows)
    for r in got:
        k = by_corner[(r["ring"][0]["x"], r["ring"][0]["y"], 2)]
        assert r["part"] == want[k]


def test_templates_equal_operators(spark):
    rows = [(dt.datetime(2026, 1, 1 + k % 3, 12), 20.0 + 0.05 * (k % 4), -160.0, float(k) if k % 5 else None) for k in range(60)]
    slab = spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, v double")
    mask = spark.createDataFrame([(20.0 + 0.05 * k, -160.0, 0.25 + 0.25 * k) for k in range(3)], "latitude double, longitude double, weight double")
    slab.createOrReplaceTempView("slab_view")
    mask.createOrReplaceTempView("mask_view")
    value = F.col("v") - F.lit(273.15)
    same = {"stats_daily": A.stats_daily, "stats_categorical": A.stats_categorical, "stats_points": A.stats_points, "station_means": A.station_means, "last_step": A.last_step}
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()), key=str)
    for name, f in same.items():
        assert plain(run_template(spark, name, "slab_view", "mask_view", "s.v - 273.15D")) == plain(f(slab, mask, value)), name
