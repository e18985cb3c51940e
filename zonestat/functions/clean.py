"""Valid polygons from any rings: split at 180, snapped, noded where edges cross, rebuilt by the even-odd rule, nested.

All but the last walk round each place's edges are joins: edges of a place meet in bands of latitude, each crossing cuts both, equal
pieces cancel in pairs, and the parity of pieces to one side of a piece says where the inside lies.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .geometry import nested_rings, rings_from, split_vertices, vertices_of

#: Nodes are told apart to this many decimals of a degree.
DECIMALS = 11
#: Bands of a place, at most.
MOST_BANDS = 1 << 16
#: Parity is counted along lines of this slope, so that no piece lies along one.
SLOPE = 0.01371


def _dealt(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows (with place_id) in the bands that they span, as many as a place has rows for: ``band``, ``first_band``."""
    spans = rows.withColumns({"low_": low, "high_": high})
    sizes = spans.groupBy("place_id").agg(F.min("low_").alias("y0_"), ((F.max("high_") - F.min("low_")) / F.least(F.lit(MOST_BANDS), F.greatest(F.lit(1), F.ceil(F.count("*") / 4)))).alias("wide_"))
    band = lambda c: F.floor(F.coalesce(F.try_divide(F.col(c) - F.col("y0_"), F.col("wide_")), F.lit(0.0)))
    spans = spans.join(sizes, "place_id").withColumns({"first_band": band("low_"), "last_": band("high_")})
    return spans.withColumn("band", F.explode(F.sequence("first_band", "last_"))).drop("low_", "high_", "y0_", "wide_", "last_")


def _on(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a point lies inside an edge, to the tolerance of a node."""
    length = F.sqrt((bx - ax) ** 2 + (by - ay) ** 2)
    along = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length
    off = F.abs((px - ax) * (by - ay) - (py - ay) * (bx - ax)) / length
    least = 10.0**-DECIMALS
    return (off <= least) & (along > least) & (along < length - least)


def noded(edges: DataFrame) -> DataFrame:
    """Edges (place_id, e, ax, ay, bx, by) cut wherever they meet: pieces without their direction, those that lie on each other an odd number of times."""
    names = ("ax", "ay", "bx", "by")
    bands = _dealt(edges, F.least("ay", "by"), F.greatest("ay", "by"))
    other = bands.select("place_id", "band", *[F.col(c).alias(f"{c}2") for c in ("e", *names, "first_band")])
    pairs = bands.join(other, ["place_id", "band"]).where((F.col("e") < F.col("e2")) & (F.col("band") == F.greatest("first_band", "first_band2")))
    a, b, c, d = ((F.col(x), F.col(y)) for x, y in (("ax", "ay"), ("bx", "by"), ("ax2", "ay2"), ("bx2", "by2")))
    apart = lambda k: (F.least(a[k], b[k]) > F.greatest(c[k], d[k])) | (F.least(c[k], d[k]) > F.greatest(a[k], b[k]))
    pairs = pairs.where(~apart(0) & ~apart(1))
    turn = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    t = F.try_divide((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0]), turn)
    u = F.try_divide((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0]), turn)
    node = lambda x, y: F.struct(F.round(x, DECIMALS).alias("x"), F.round(y, DECIMALS).alias("y"))
    proper = F.when((t > 0) & (t < 1) & (u > 0) & (u < 1), node(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    ends = lambda points, line: [F.when(_on(*p, *line[0], *line[1]), node(*p)) for p in points]
    touching = F.coalesce(*ends((c, d), (a, b)), *ends((a, b), (c, d)))
    crossing = F.when(touching.isNull(), proper)  # where an end lies on the other edge, that end is the node
    met = pairs.select("place_id", "e", "e2", F.array(*ends((c, d), (a, b)), crossing).alias("p"), F.array(*ends((a, b), (c, d)), crossing).alias("q"))
    cuts = met.select("place_id", "e", F.explode("p").alias("n")).unionByName(met.select("place_id", F.col("e2").alias("e"), F.explode("q").alias("n"))).where("n is not null")
    cuts = cuts.groupBy("place_id", "e").agg(F.collect_set("n").alias("nodes"))  # by an edge's own crossings
    whole = edges.join(cuts, ["place_id", "e"], "left")
    far = lambda p: (p["x"] - F.col("ax")) ** 2 + (p["y"] - F.col("ay")) ** 2
    nodes = F.concat(F.array(node(F.col("ax"), F.col("ay")), node(F.col("bx"), F.col("by"))), F.coalesce("nodes", F.array().cast("array<struct<x: double, y: double>>")))
    path = F.array_sort(F.transform(nodes, lambda p: F.struct(far(p).alias("far"), p["x"].alias("x"), p["y"].alias("y"))))
    steps = F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("a"), F.slice(path, 2, F.size(path) - 1).alias("b"))
    pieces = whole.select("place_id", F.explode(steps).alias("s")).where("s.a.x <> s.b.x or s.a.y <> s.b.y")
    pick = lambda p: F.struct(F.col(f"s.{p}.x").alias("x"), F.col(f"s.{p}.y").alias("y"))
    pieces = pieces.select("place_id", F.least(pick("a"), pick("b")).alias("a"), F.greatest(pick("a"), pick("b")).alias("b"))
    odd = pieces.groupBy("place_id", "a", "b").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return odd.select("place_id", F.xxhash64("a", "b").alias("e"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def oriented(pieces: DataFrame) -> DataFrame:
    """Pieces with the inside on their left: that of more edges, an odd number, to their right."""
    up = lambda x, y: F.col(y) + SLOPE * F.col(x)
    rows = pieces.withColumns({"av": up("ax", "ay"), "bv": up("bx", "by")})
    bands = _dealt(rows, F.least("av", "bv"), F.greatest("av", "bv"))
    middle = rows.withColumns({"mx": (F.col("ax") + F.col("bx")) / 2, "mv": (F.col("av") + F.col("bv")) / 2})
    sizes = rows.groupBy("place_id").agg(F.min(F.least("av", "bv")).alias("y0_"), ((F.max(F.greatest("av", "bv")) - F.min(F.least("av", "bv"))) / F.least(F.lit(MOST_BANDS), F.greatest(F.lit(1), F.ceil(F.count("*") / 4)))).alias("wide_"))
    middle = middle.join(sizes, "place_id").withColumn("band", F.floor(F.coalesce(F.try_divide(F.col("mv") - F.col("y0_"), F.col("wide_")), F.lit(0.0))))
    lines = bands.select("place_id", "band", *[F.col(c).alias(f"{c}2") for c in ("e", "ax", "av", "bx", "bv")])
    at = F.col("ax2") + (F.col("mv") - F.col("av2")) * F.try_divide(F.col("bx2") - F.col("ax2"), F.col("bv2") - F.col("av2"))
    right = (F.col("e2") != F.col("e")) & ((F.col("av2") > F.col("mv")) != (F.col("bv2") > F.col("mv"))) & (at > F.col("mx"))
    keys = ["place_id", "e", "ax", "ay", "bx", "by", "av", "bv"]
    counted = middle.join(lines, ["place_id", "band"]).groupBy(*keys).agg(F.count_if(right).alias("n"))
    along = (F.col("bv") > F.col("av")) == (F.col("n") % 2 == 0)
    turned = lambda p, q: F.when(along, F.col(p)).otherwise(F.col(q))
    return counted.select("place_id", turned("ax", "bx").alias("ax"), turned("ay", "by").alias("ay"), turned("bx", "ax").alias("bx"), turned("by", "ay").alias("by"))


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """One place's directed pieces as simple closed rings: at a node the walk takes the next way clockwise, and a node met again closes a ring."""
    ways: dict[tuple[float, float], list[tuple[float, float, float]]] = {}
    for ax, ay, bx, by in pdf[["ax", "ay", "bx", "by"]].sort_values(["ax", "ay", "bx", "by"]).itertuples(index=False):
        ways.setdefault((ax, ay), []).append((math.atan2(by - ay, bx - ax), bx, by))
    out = []
    number = 0
    for start in list(ways):
        while ways.get(start):
            walk, place = [start], {start: 0}
            _, *node = ways[start].pop()
            node = tuple(node)
            while True:
                if node in place:
                    ring = [*walk[place[node] :], node]
                    for gone in walk[place[node] + 1 :]:
                        del place[gone]
                    walk = walk[: place[node] + 1]
                    out += [(number, k, x, y) for k, (x, y) in enumerate(ring)]
                    number += 1
                else:
                    place[node] = len(walk)
                    walk.append(node)
                if len(walk) == 1 and not ways.get(node):
                    break
                if not ways.get(node):
                    raise ValueError("a ring doesn't close")
                if len(walk) == 1:
                    _, *nxt = ways[node].pop()
                else:
                    back = math.atan2(walk[-2][1] - node[1], walk[-2][0] - node[0])
                    choice = min(range(len(ways[node])), key=lambda i: (back - ways[node][i][0]) % (2 * math.pi) or 2 * math.pi)
                    _, *nxt = ways[node].pop(choice)
                node = tuple(nxt)
    pid = pdf["place_id"].iloc[0]
    return pd.DataFrame([(pid, *r) for r in out], columns=["place_id", "k_ring", "k", "x", "y"])


def cleaned(places: DataFrame) -> DataFrame:
    """Places (place_id, parts: arrays of rings of points) with valid parts: place_id, parts.

    Longitudes come to lie within [-180, 180], vertices near the antimeridian on it; rings cross neither themselves nor others; what
    overlaps counts by the even-odd rule; shells run counter-clockwise and holes clockwise. A place of which no area is left, or that
    has no parts, has null parts. A ring that circles a pole fails.
    """
    rings = places.select("place_id", F.posexplode("parts").alias("part", "rings")).select("place_id", "part", F.posexplode("rings").alias("ring_no", "ring"))
    by = ["place_id", "part", "ring_no"]
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    points = vertices_of(rings.where(F.size("ring") >= 3).withColumn("ring", closed), by)
    split = split_vertices(points, by, shell="ring_no")
    side = F.when(F.abs(F.abs("x") - 180) <= 1e-4, F.signum("x") * 180.0).otherwise(F.round("x", DECIMALS))
    split = split.withColumns({"x": side, "y": F.round("y", DECIMALS)})
    along = Window.partitionBy(*by, "world").orderBy("k")
    edges = split.select("place_id", F.xxhash64(*by, "world", "k").alias("e"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(along).alias("bx"), F.lead("y").over(along).alias("by"))
    edges = written(edges.where("bx is not null and (ax <> bx or ay <> by)"))
    pieces = written(oriented(written(noded(edges))))
    kind = places.schema["place_id"].dataType.simpleString()
    walked = pieces.groupBy("place_id").applyInPandas(_walk, f"place_id {kind}, k_ring int, k int, x double, y double")  # one geometry's pieces
    whole = rings_from(walked, ["place_id", "k_ring"])
    flat = whole.select(F.col("place_id").alias("feature"), F.col("k_ring").alias("k"), F.reverse("ring").alias("ring"))  # shells clockwise, as nested_rings takes them
    nested = nested_rings(written(flat))
    parts = nested.groupBy("feature", "part").agg(F.array_sort(F.collect_list(F.struct("ring_no", "ring"))).alias("r"))
    parts = parts.select("feature", "part", F.transform("r", lambda r: F.reverse(r["ring"])).alias("rings"))
    joined = parts.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("part", "rings"))).alias("p")).select(F.col("feature").alias("place_id"), F.transform("p", lambda p: p["rings"]).alias("parts"))
    return places.select("place_id").distinct().join(joined, "place_id", "left")
