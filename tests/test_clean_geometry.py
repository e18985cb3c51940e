"""Valid polygons from any rings, against areas and parities by force."""

import math
import random

import pytest

from zonestat.functions.clean import cleaned

PARTS = "place_id string, parts array<array<array<struct<x: double, y: double>>>>"


def shaped(places):
    return [(pid, None if parts is None else [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] for rings in parts]) for pid, parts in places.items()]


def clean(spark, places):
    rows = cleaned(spark.createDataFrame(shaped(places), PARTS)).collect()
    return {r["place_id"]: None if r["parts"] is None else [[[(p["x"], p["y"]) for p in ring] for ring in rings] for rings in r["parts"]] for r in rows}


def turn(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def inside(parts, x, y):
    """By the even-odd rule over all rings."""
    n = 0
    for rings in parts:
        for ring in rings:
            ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
            n += sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:]))
    return n % 2 == 1


def crosses(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < -1e-18 and side(c, d, a) * side(c, d, b) < -1e-18


def check(parts):
    """Closed simple rings that don't cross, shells counter-clockwise, holes clockwise and inside their shells."""
    edges = []
    for rings in parts:
        for k, ring in enumerate(rings):
            assert ring[0] == ring[-1] and len(ring) >= 4 and len(set(ring)) == len(ring) - 1
            assert (turn(ring) > 0) == (k == 0)
            assert all(-180 <= x <= 180 for x, _ in ring)
            edges += list(zip(ring, ring[1:]))
    assert not any(crosses(*e, *f) for i, e in enumerate(edges) for f in edges[:i])
    return sum(turn(ring) for rings in parts for ring in rings)


def test_known_shapes(spark):
    square = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    star = [(10 + 5 * math.sin(4 * math.pi * k / 5), 5 * math.cos(4 * math.pi * k / 5)) for k in range(5)]
    got = clean(spark, {
        "plain": [[square(0, 0, 4, 4)]], "clockwise": [[square(0, 0, 4, 4)[::-1]]], "open": [[square(0, 0, 4, 4)[:-1]]], "bow": [[[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]]], "star": [[[*star, star[0]]]],
        "hole": [[square(0, 0, 9, 9), square(2, 2, 4, 4)]], "touching": [[square(0, 0, 9, 9), [(0, 4), (3, 3), (3, 6), (0, 4)]]], "crossing": [[square(0, 0, 9, 9), square(7, 7, 12, 12)]],
        "overlap": [[square(0, 0, 4, 4)], [square(2, 2, 6, 6)]], "side": [[square(0, 0, 2, 2)], [square(2, 0, 4, 2)]], "spike": [[[(0, 0), (4, 0), (4, 2), (9, 2), (4, 2), (4, 4), (0, 4), (0, 0)]]],
        "flat": [[[(0, 0), (4, 0), (2, 0), (0, 0)]]], "none": None, "empty": [], "twice": [[square(0, 0, 4, 4)], [square(0, 0, 4, 4)]],
        "across": [[[(175, 0), (-175, 0), (-175, 5), (175, 5), (175, 0)]]], "near": [[[(170, 0), (179.99995, 0), (179.99996, 5), (170, 5), (170, 0)]]],
        "comb": [[[(175, 0), (-175, 0), (-175, 2), (178, 2), (178, 4), (-175, 4), (-175, 6), (175, 6), (175, 0)]]],
    })
    area = {k: None if v is None else round(check(v), 6) for k, v in got.items()}
    r = 5 * math.sin(math.radians(18)) / math.sin(math.radians(126))
    tips = round(5 * (5 * r * math.sin(math.radians(36)) - r * r * math.sin(math.radians(72)) / 2), 6)
    assert area == {
        "plain": 16, "clockwise": 16, "open": 16, "bow": 8, "star": pytest.approx(tips, abs=1e-5), "hole": 77, "touching": 81 - 4.5, "crossing": 77 + 21, "overlap": 24, "side": 8, "spike": 16,
        "flat": None, "none": None, "empty": None, "twice": None, "across": 50, "near": pytest.approx(50, abs=1e-3), "comb": 60 - 14,
    }
    assert len(got["bow"]) == 2 and len(got["star"]) == 5 and [len(p) for p in got["hole"]] == [2] and len(got["side"]) == 1
    assert sorted(len(p) for p in got["across"]) == [1, 1] and max(x for x, _ in got["near"][0][0]) == 180.0
    assert len(got["comb"]) == 3


def test_random_tangles(spark):
    """Rings that cross themselves and each other many times: every point is inside exactly where the even-odd rule says."""
    rng = random.Random(23)
    places = {}
    for k in range(12):
        ring = lambda n: [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(n)]
        places[f"p{k}"] = [[[*(r := ring(rng.randrange(4, 16))), r[0]] for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(1, 3))]
    got = clean(spark, places)
    for pid, parts in places.items():
        check(got[pid])
        for _ in range(400):
            x, y = rng.uniform(0, 10), rng.uniform(0, 10)
            assert inside(parts, x, y) == inside(got[pid], x, y), (pid, x, y)
        for rings in got[pid]:
            for hole in rings[1:]:
                assert inside([[rings[0]]], sum(x for x, _ in hole[:3]) / 3, sum(y for _, y in hole[:3]) / 3) or len(hole) > 4


def test_edges_meet_in_bands(spark):
    from pyspark.sql import functions as F

    from zonestat.functions.clean import noded

    rows = [("p", k, math.cos(k), math.sin(k), math.cos(k + 2.5), math.sin(k + 2.5)) for k in range(50)]
    edges = spark.createDataFrame(rows, "place_id string, e long, ax double, ay double, bx double, by double")
    found = noded(edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = 50 + 2 * sum(crosses(r[2:4], r[4:6], s[2:4], s[4:6]) for i, r in enumerate(rows) for s in rows[:i])
    assert found.count() == want and found.select(F.count_distinct("e")).first()[0] == want
