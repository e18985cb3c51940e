"""Polygons as arrays of parts, rings and points (x, y): reading, turning, splitting at the antimeridian, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POINT = "array<array<array<double>>>"


def geojson_parts(geometry: Column) -> Column:
    """Parts of a GeoJSON Polygon or MultiPolygon in text; null for other kinds."""
    kind = F.get_json_object(geometry, "$.type")
    text = F.get_json_object(geometry, "$.coordinates")
    polygon, several = F.from_json(text, _POINT), F.from_json(text, f"array<{_POINT}>")
    parts = F.when(kind == "Polygon", F.array(polygon)).when(kind == "MultiPolygon", several)
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))


def ring_turn(ring: Column) -> Column:
    """Twice a ring's signed area: positive for clockwise rings."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + (e["b"]["x"] - e["a"]["x"]) * (e["b"]["y"] + e["a"]["y"]))


def counter_clockwise(ring: Column) -> Column:
    return F.when(ring_turn(ring) > 0, F.reverse(ring)).otherwise(ring)


def snapped(ring: Column, within: float = 1e-4) -> Column:
    """Points near the antimeridian moved onto it."""
    side = lambda x: F.when(F.abs(F.abs(x) - 180) <= within, F.signum(x) * 180.0).otherwise(x)
    return F.transform(ring, lambda p: F.struct(side(p["x"]).alias("x"), p["y"].alias("y")))


def vertices_of(rings: DataFrame, by: list[str], ring: str = "ring") -> DataFrame:
    """Rings as rows: ``by``, k, x, y."""
    return rings.select(*by, F.posexplode(ring).alias("k", "p")).select(*by, "k", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))


def rings_from(vertices: DataFrame, by: list[str], ring: str = "ring") -> DataFrame:
    """Rows of vertices as rings: ``by`` and an array of points by k."""
    points = F.array_sort(F.collect_list(F.struct("k", "x", "y")))
    return vertices.groupBy(*by).agg(points.alias("points_")).select(*by, F.transform("points_", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias(ring))


def unwrapped(vertices: DataFrame, by: list[str]) -> DataFrame:
    """Closed rings without jumps over 180 degrees: longitudes run on beyond the antimeridian. A ring that circles a pole fails.

    Turns of the globe are a running sum of the jumps along the ring.
    """
    along = Window.partitionBy(*by).orderBy("k")
    jump = F.col("x") - F.lag("x").over(along)
    rows = vertices.withColumn("turn_", F.when(jump > 180, -360.0).when(jump < -180, 360.0).otherwise(0.0))
    rows = rows.withColumn("x", F.col("x") + F.sum("turn_").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_ = F.abs(F.last("x").over(whole) - F.first("x").over(whole)) > 1e-6
    return rows.withColumn("x", F.when(open_, F.raise_error(F.lit("a ring circles a pole")).cast("double")).otherwise(F.col("x"))).drop("turn_")


def clipped(vertices: DataFrame, by: list[str], at: float, below: bool) -> DataFrame:
    """The parts of closed rings on one side of a meridian, closed again; rings with nothing there are left out.

    Each edge gives where it enters the side and, if it ends there, its end: one step from each vertex to the next.
    """
    along = Window.partitionBy(*by).orderBy("k")
    inside = lambda x: (x <= at) if below else (x >= at)
    edges = vertices.withColumns({"x2": F.lead("x").over(along), "y2": F.lead("y").over(along)}).where(F.col("x2").isNotNull())
    y = F.col("y") + (F.lit(at) - F.col("x")) * F.try_divide(F.col("y2") - F.col("y"), F.col("x2") - F.col("x"))
    cross, end = F.struct(F.lit(float(at)).alias("x"), y.alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    kept = F.when(inside(F.col("x")) & inside(F.col("x2")), F.array(end)).when(inside(F.col("x")), F.array(cross)).when(inside(F.col("x2")), F.array(cross, end)).otherwise(F.array().cast("array<struct<x: double, y: double>>"))
    points = edges.select(*by, "k", F.posexplode(kept).alias("step_", "p")).select(*by, (2 * F.col("k") + F.col("step_")).alias("k"), "p.x", "p.y")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = points.withColumns({"n_": F.count("*").over(whole), "last_": F.col("k") == F.last("k").over(whole), "x0_": F.first("x").over(whole), "y0_": F.first("y").over(whole)}).where("n_ >= 3")
    closing = F.array(F.struct("k", "x", "y"), F.struct((F.col("k") + 1).alias("k"), F.col("x0_").alias("x"), F.col("y0_").alias("y")))
    closed = told.select(*by, F.explode(F.when(F.col("last_"), closing).otherwise(F.slice(closing, 1, 1))).alias("p"))
    return closed.select(*by, "p.k", "p.x", "p.y")


def split_vertices(vertices: DataFrame, by: list[str], shell: str | None = None) -> DataFrame:
    """Closed rings (``by``, k, x, y) in pieces within [-180, 180]: ``by``, world, k, x, y; ``world`` counts turns of the globe.

    Only rings that leave [-180, 180] are cut, each for the worlds that it touches. With ``shell``, the last column of ``by``
    numbers a part's rings and 0 is its shell: holes are moved by whole turns to where their shell lies. Pole-circling rings fail.
    """
    rows = unwrapped(vertices, by)
    ring = Window.partitionBy(*by)
    rows = rows.withColumns({"west_": F.min("x").over(ring), "east_": F.max("x").over(ring)})
    if shell:
        part = Window.partitionBy(*[c for c in by if c != shell])
        centre = (F.col("west_") + F.col("east_")) / 2
        turn = F.round((F.max(F.when(F.col(shell) == 0, centre)).over(part) - centre) / 360) * 360
        rows = rows.withColumn("turn_", F.coalesce(turn, F.lit(0.0)))
        rows = rows.withColumns({c: F.col(c) + F.col("turn_") for c in ("x", "west_", "east_")}).drop("turn_")
    world = lambda x: F.floor((x + 180) / 360).cast("int")
    last = F.greatest(world(F.col("west_")), F.ceil((F.col("east_") + 180) / 360).cast("int") - 1)
    rows = rows.withColumn("world", F.explode(F.sequence(world(F.col("west_")), last))).withColumn("x", F.col("x") - 360.0 * F.col("world"))
    inner = (F.col("west_") >= -180) & (F.col("east_") <= 180)
    keys = [*by, "world"]
    cut = clipped(clipped(rows.where(~inner).select(*keys, "k", "x", "y"), keys, -180.0, False), keys, 180.0, True)
    width = Window.partitionBy(*keys)
    cut = cut.withColumn("wide_", F.max("x").over(width) - F.min("x").over(width)).where("wide_ > 1e-9").drop("wide_")
    return rows.where(inner).select(*keys, "k", "x", "y").unionByName(cut.select(*keys, "k", "x", "y"))


def split_at_antimeridian(rings: DataFrame, by: list[str], ring: str = "ring") -> DataFrame:
    """Rings (closed arrays of points) in pieces within [-180, 180], with ``world``; see ``split_vertices``."""
    return rings_from(split_vertices(vertices_of(rings, by, ring), by), [*by, "world"], ring)


def widest_jump(rings: DataFrame, by: list[str], ring: str = "ring") -> DataFrame:
    """The largest longitude step of each group's edges: over 180 degrees means that a ring crosses unsplit."""
    numbered = rings.select(*by, F.xxhash64(ring).alias("ring_"), ring)
    rows = vertices_of(numbered, [*by, "ring_"], ring)
    step = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy(*by, "ring_").orderBy("k", "x")))
    return rows.withColumn("step_", step).groupBy(*by).agg(F.max("step_").alias("jump"))


def inner_points(edges: DataFrame, by: list[str]) -> DataFrame:
    """A point inside each ring (``by``, lon, lat): in the middle of its widest stretch at half its height."""
    middle = edges.groupBy(*by).agg(((F.min("ay") + F.max("ay")) / 2).alias("lat"))
    met = edges.join(middle, by).where((F.col("ay") > F.col("lat")) != (F.col("by") > F.col("lat")))
    x = F.col("ax") + (F.col("lat") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    rows = met.withColumn("x_", x).withColumn("n_", F.row_number().over(Window.partitionBy(*by).orderBy("x_")))
    nxt = F.lead("x_").over(Window.partitionBy(*by).orderBy("x_"))
    spans = rows.withColumn("to_", nxt).where("n_ % 2 = 1 and to_ is not null")
    return spans.groupBy(*by, "lat").agg(F.max_by((F.col("x_") + F.col("to_")) / 2, F.col("to_") - F.col("x_")).alias("lon")).select(*by, "lon", "lat")


def nested_rings(features: DataFrame, feature: str = "feature") -> DataFrame:
    """Flat rings (feature, k, ring) as parts: clockwise rings are shells, the others holes of the least shell that holds them.

    Returns (feature, part, ring_no, ring), ring_no 0 a shell; a hole without a shell becomes a shell of its own. A point inside
    each hole meets shells by tiles and their edges by bands of latitude, all in equality joins.
    """
    from ..operators.mask import edges_from_parts, holders

    rows = features.select(feature, "k", "ring", ring_turn(F.col("ring")).alias("turn"))
    edges = edges_from_parts(rows.select(F.struct(feature, "k", "turn").alias("place_id"), F.array(F.array("ring")).alias("parts")))
    edges = edges.select(F.col(f"place_id.{feature}").alias("place_id"), F.col("place_id.k").alias("part"), F.col("place_id.turn").alias("turn"), F.lit(0).alias("ring"), "ax", "ay", "bx", "by")
    points = inner_points(edges.where("turn <= 0"), ["place_id", "part"]).withColumnRenamed("part", "hole")
    shells = edges.where("turn > 0")
    box = edges.groupBy("place_id", "part").agg(F.min("ax").alias("x0"), F.min("ay").alias("y0"), F.max("ax").alias("x1"), F.max("ay").alias("y1"), F.first("turn").alias("size"))
    own = box.select("place_id", F.col("part").alias("hole"), *[F.col(c).alias(f"h_{c}") for c in ("x0", "y0", "x1", "y1")])
    held = holders(shells, points, ["hole"], within=True).join(box, ["place_id", "part"]).join(own, ["place_id", "hole"])
    # a shell inside the hole may hold the point as well
    around = (F.col("x0") <= F.col("h_x0")) & (F.col("y0") <= F.col("h_y0")) & (F.col("x1") >= F.col("h_x1")) & (F.col("y1") >= F.col("h_y1"))
    held = held.where(around).groupBy("place_id", "hole").agg(F.min_by("part", F.struct("size", "part")).alias("part"))
    held = held.select(F.col("place_id").alias(feature), F.col("hole").alias("k"), "part")
    placed = rows.where("turn <= 0").select(feature, "k", "ring").join(held, [feature, "k"], "left").withColumn("shell", F.col("part").isNull()).withColumn("part", F.coalesce("part", "k"))
    all_ = rows.where("turn > 0").select(feature, "k", "ring", F.lit(True).alias("shell"), F.col("k").alias("part")).unionByName(placed)
    order = Window.partitionBy(feature, "part").orderBy(F.desc("shell"), "k")
    return all_.withColumn("ring_no", F.row_number().over(order) - 1).select(feature, "part", "ring_no", "ring")
