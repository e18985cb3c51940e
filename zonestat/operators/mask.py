"""Polygons to weighted grid cells, in DataFrame operations alone.

Places are edge tables: (place_id, part, ring, k, ax, ay, bx, by), ring 0 a part's shell, the others its
holes. Axes are tables of cell centres. An axis is one vector, small beside any slab: it is read once (at most
LONGEST cells) and goes into expressions as a constant, so an edge finds its rows and columns by binary search,
without a join, and makes rows only for cells that it meets. Positions meet parts by tiles, then edges by
bands of latitude, in equality joins. Nothing here compares every cell or point with every edge.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bands of latitude that a part's edges and points are dealt to, at most.
MOST_BANDS = 1 << 16
#: Cells of an axis, at most.
LONGEST = 1 << 20
#: Sides of tiles in degrees; a part's box is dealt to the least ones of which it has TILES or fewer each way.
SIDES, TILES = (1.0, 8.0, 64.0, 512.0), 8
EDGES = "place_id string, part int, ring int, k int, ax double, ay double, bx double, by double"


def edges_of(spark: SparkSession, places: dict[str, list[list[list[tuple[float, float]]]]]) -> DataFrame:
    """Edge rows of places given as parts of closed rings (the first ring of a part is its shell)."""
    rows = [
        (pid, p, r, k, *map(float, (*ring[k], *ring[k + 1])))
        for pid, parts in places.items() for p, rings in enumerate(parts) for r, ring in enumerate(rings) for k in range(len(ring) - 1)
    ]
    return spark.createDataFrame(rows, EDGES)


def edges_from_parts(places: DataFrame) -> DataFrame:
    """Edge rows of a column ``parts`` (array of parts, rings, points with x and y)."""
    rings = places.select("place_id", F.posexplode("parts").alias("part", "rings")).select("place_id", "part", F.posexplode("rings").alias("ring", "points"))
    points = rings.select("place_id", "part", "ring", F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b")).alias("pairs"))
    return points.select("place_id", "part", "ring", F.posexplode("pairs").alias("k", "e")).select("place_id", "part", "ring", "k", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def axis(spark: SparkSession, start: float, step: float, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.lit(step) * F.col("id")).alias("centre"))


def axis_edges(centres: DataFrame) -> DataFrame:
    """Lower and upper edges of an axis of either direction (i by ascending centre, centre, lo, hi).

    Edges lie half way between neighbours; the outer ones are mirrored; a single cell has width 1.
    An axis is one vector of cell centres, small beside any slab, so its one-task window is bounded.
    """
    order = Window.orderBy("centre")
    before, after = F.lag("centre").over(order), F.lead("centre").over(order)
    c = F.col("centre")
    half_before, half_after = (c - before) / 2, (after - c) / 2
    half = F.lit(0.5)
    return centres.select(
        (F.row_number().over(order) - 1).alias("i"), "centre", (c - F.coalesce(half_before, half_after, half)).alias("lo"), (c + F.coalesce(half_after, half_before, half)).alias("hi")
    )


@dataclass(frozen=True)
class AxisIndex:
    """An axis by ascending centre: what each cell's centre and edges are, and which cells a value lies among."""

    centre: list[float]
    lo: list[float]
    hi: list[float]

    def vector(self, name: str) -> Column:
        values = getattr(self, name)
        return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>") if values else F.array().cast("array<double>")

    def count(self, name: str, value: Column, closed: bool = False) -> Column:
        """How many cells have a smaller centre or edge than ``value`` (or an equal one, if ``closed``), by binary search."""
        at = self.vector(name)
        before = lambda k: F.get(at, k - 1) <= value if closed else F.get(at, k - 1) < value
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(self.centre).bit_length()))]).cast("array<int>")
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(before(n + step), n + step).otherwise(n))

    def spread(self, rows: DataFrame, first: str, last: str, number: str, **names: str) -> DataFrame:
        """A row for each cell from ``first`` to ``last``: its number, and its centre or edges by ``names``; cells off the axis have null ones."""
        cells = rows.where(F.col(first) <= F.col(last)).withColumn(number, F.explode(F.sequence(first, last)))
        return cells.withColumns({name: F.get(self.vector(of), F.col(number)) for name, of in names.items()})


def _indexes(*axes: DataFrame) -> list[AxisIndex]:
    """The indexes of axes (centre, lo, hi), read in one job."""
    tagged = [a.select(F.lit(k).alias("k"), *[F.col(c).cast("double").alias(c) for c in ("centre", "lo", "hi")]).limit(LONGEST + 1) for k, a in enumerate(axes)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    rows = whole.collect()
    found = [sorted(tuple(r)[1:] for r in rows if r["k"] == k) for k in range(len(axes))]
    if any(len(f) > LONGEST for f in found):
        raise ValueError(f"an axis has more than {LONGEST} cells")
    return [AxisIndex(*([r[k] for r in f] for k in range(3))) for f in found]


def axis_index(axis: DataFrame) -> AxisIndex:
    """The index of ``axis_edges``' rows."""
    return _indexes(axis)[0]


def axis_spacing(centres: DataFrame) -> DataFrame:
    """The median gap between neighbouring centres."""
    gap = F.col("centre") - F.lag("centre").over(Window.orderBy("centre"))
    return centres.select(gap.alias("gap")).agg(F.median("gap").alias("spacing"))


def part_boxes(edges: DataFrame) -> DataFrame:
    """By part: the bounding box of its shell."""
    shell = edges.where("ring = 0")
    return shell.groupBy("place_id", "part").agg(F.min("ax").alias("x0"), F.min("ay").alias("y0"), F.max("ax").alias("x1"), F.max("ay").alias("y1"))


def _within(boxes: DataFrame, x: AxisIndex, y: AxisIndex) -> DataFrame:
    """Cells (by part) whose centres lie in a part's box."""
    ends = {"i0": x.count("centre", F.col("x0")), "i1": x.count("centre", F.col("x1"), closed=True) - 1, "j0": y.count("centre", F.col("y0")), "j1": y.count("centre", F.col("y1"), closed=True) - 1}
    rows = y.spread(boxes.withColumns(ends), "j0", "j1", "j", lat="centre")
    return x.spread(rows, "i0", "i1", "i", lon="centre").select("place_id", "part", "i", "j", "lon", "lat")


def candidates(edges: DataFrame, ax: DataFrame, ay: DataFrame) -> DataFrame:
    """Cells whose centres lie in the box of one of the place's parts."""
    return _within(part_boxes(edges), *_indexes(ax, ay)).select("place_id", "i", "j", "lon", "lat").distinct()


def _crossings(edges: DataFrame, y: AxisIndex) -> DataFrame:
    ends = {"j0": y.count("centre", F.least("ay", "by")), "j1": y.count("centre", F.greatest("ay", "by")) - 1}
    rows = y.spread(edges.where(F.col("ay") != F.col("by")).withColumns(ends), "j0", "j1", "j", lat="centre")
    at = F.col("ax") + (F.col("lat") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    return rows.groupBy("place_id", "part", "j", "lat").agg(F.sort_array(F.collect_list(at)).alias("xs"))


def crossings(edges: DataFrame, ay: DataFrame) -> DataFrame:
    """Where each row of cells crosses a part's rings: (place_id, part, j, lat, xs ascending); half-open in latitude."""
    return _crossings(edges, axis_index(ay))


def _spans(edges: DataFrame, x: AxisIndex, y: AxisIndex) -> DataFrame:
    """Runs of cells whose centres are inside, between pairs of crossings of a row: place_id, j, lat, i0 and i1."""
    rows = _crossings(edges, y).where(F.size("xs") >= 2).withColumn("pair", F.explode(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))))
    spans = rows.select("place_id", "j", "lat", F.element_at("xs", F.col("pair")).alias("a"), F.element_at("xs", F.col("pair") + 1).alias("b"))
    return spans.select("place_id", "j", "lat", x.count("centre", F.col("a")).alias("i0"), (x.count("centre", F.col("b"), closed=True) - 1).alias("i1")).where("i0 <= i1")


def _scan(edges: DataFrame, x: AxisIndex, y: AxisIndex) -> DataFrame:
    return x.spread(_spans(edges, x, y), "i0", "i1", "i", lon="centre").select("place_id", "i", "j", "lon", "lat").distinct()


def inside_scan(edges: DataFrame, ax: DataFrame, ay: DataFrame) -> DataFrame:
    """Cells whose centres are inside, by filling rows between pairs of crossings (closed in longitude)."""
    return _scan(edges, *_indexes(ax, ay))


def _bands(edges: DataFrame) -> DataFrame:
    """By part: where its bands of latitude begin and how high they are; an edge of middling length spans one or two."""
    return edges.groupBy("place_id", "part").agg(
        F.min("ay").alias("y0"), ((F.max("ay") - F.min("ay")) / F.least(F.lit(MOST_BANDS), F.greatest(F.lit(1), F.ceil(F.count("*") / 4)))).alias("high")
    )


def _parity(points: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Points (``by``, part) with an odd number of a part's edges to their right; points carry place_id, lon and lat."""
    bands = _bands(edges)  # one row for each part
    y, x = F.col("lat"), F.col("lon")
    band = lambda at: F.floor(F.coalesce(F.try_divide(at - F.col("y0"), F.col("high")), F.lit(0.0)))
    spans = edges.where(F.col("ay") != F.col("by")).join(bands, ["place_id", "part"])
    spans = spans.select("place_id", "part", "ax", "ay", "bx", "by", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by")))).alias("band"))
    placed = points.select(*by, "part").join(bands, ["place_id", "part"]).select(*by, "part", band(y).alias("band"))
    at = F.col("ax") + (y - F.col("ay")) * F.try_divide(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    crosses = ((F.col("ay") > y) != (F.col("by") > y)) & (x < at)
    met = placed.join(spans, ["place_id", "part", "band"]).groupBy(*by, "part").agg(F.count_if(crosses).alias("n"))
    return met.where(F.col("n") % 2 == 1).select(*by, "part")


def inside_parity(edges: DataFrame, ax: DataFrame, ay: DataFrame) -> DataFrame:
    """Cells whose centres are inside, by counting crossings of each candidate: the second, independent way."""
    return _parity(_within(part_boxes(edges), *_indexes(ax, ay)), edges, ["place_id", "i", "j", "lon", "lat"]).drop("part").distinct()


def _tile(at: str | Column, side: Column) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / side).cast("int")


def _boxed(points: DataFrame, boxes: DataFrame, by: list[str], within: bool) -> DataFrame:
    """Points (``by``, lon, lat) with the parts whose boxes hold them; ``within`` their own place_id alone.

    A box is dealt to the tiles that it touches, of the least side that makes them few; a point lies in one tile of each side.
    """
    side = F.lit(SIDES[-1])
    for s in reversed(SIDES[:-1]):
        side = F.when(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) <= (TILES - 1) * s, F.lit(s)).otherwise(side)
    dealt = boxes.withColumn("side", side)
    dealt = dealt.withColumn("tx", F.explode(F.sequence(_tile("x0", F.col("side")), _tile("x1", F.col("side"))))).withColumn("ty", F.explode(F.sequence(_tile("y0", F.col("side")), _tile("y1", F.col("side")))))
    placed = points.withColumn("side", F.explode(F.array(*map(F.lit, SIDES)))).withColumns({"tx": _tile("lon", F.col("side")), "ty": _tile("lat", F.col("side"))})
    met = placed.join(dealt, ["side", "tx", "ty", *(["place_id"] if within else [])])
    return met.where(F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))).select("place_id", "part", *by, "lon", "lat")


def holders(edges: DataFrame, points: DataFrame, by: list[str], within: bool = False) -> DataFrame:
    """The parts that hold each point (``by``, lon, lat): ``by``, place_id, part, lon, lat; ``within`` parts of the point's own place_id alone."""
    return _parity(_boxed(points, part_boxes(edges), by, within), edges, ["place_id", *by, "lon", "lat"])


def point_mask(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct finite positions (lon, lat) inside a place, with weight 1."""
    finite = points.select(F.col("lon").cast("double"), F.col("lat").cast("double")).where(~F.isnan("lon") & ~F.isnan("lat") & (F.abs("lon") < float("inf")) & (F.abs("lat") < float("inf")))
    return holders(edges, finite.distinct(), []).select("place_id", "lon", "lat").distinct().withColumn("weight", F.lit(1.0))


def _clipped(a: Column, b: Column, low: Column, high: Column) -> Column:
    """The integral over longitude of sin(latitude) above ``low`` and below ``high``, per degree of longitude, for a
    latitude that runs evenly from a to b. A sphere's area is the integral of sin(latitude) round its border."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    length = hi - lo
    s, e = F.greatest(lo, F.least(hi, low)), F.greatest(lo, F.least(hi, high))  # the stretch inside the band
    sin = lambda d: F.sin(F.radians(d))
    # mean of sin over the stretch; its cosine difference loses digits on short stretches, so a three-point rule stands in
    middle = (sin(s) + 4 * sin((s + e) / 2) + sin(e)) / 6
    part = F.try_divide(e - s, length) * (middle - sin(low))
    above = F.try_divide(hi - e, length) * (sin(high) - sin(low))
    flat = sin(F.greatest(low, F.least(high, a))) - sin(low)
    return F.when(length > 0, part + above).otherwise(flat)


def _swept(edges: DataFrame, cells: DataFrame, x: AxisIndex, y: AxisIndex) -> DataFrame:
    """The share of each cell (place_id, i, j) that the place's parts cover, at most 1; cells of no share are left out.

    Green's theorem edge by edge: each edge adds, signed by its direction, the area between it and a cell's lower side.
    Shells count positive and holes negative, whatever their direction; parts add up. An edge is cut at the columns' sides.
    In its column it meets the cells that it passes through; to all cells below these it adds its whole width, which
    reaches them as a running total from the top of the column. So rows are made for border cells alone.
    """
    turn = edges.groupBy("place_id", "part", "ring").agg(F.sum((F.col("bx") - F.col("ax")) * (F.col("by") + F.col("ay"))).alias("turn"))
    signed = edges.join(turn, ["place_id", "part", "ring"]).where(F.col("ax") != F.col("bx"))
    signed = signed.withColumns({"sign": F.signum("turn") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0), "left": F.least("ax", "bx"), "right": F.greatest("ax", "bx")})
    signed = signed.withColumns({"i0": x.count("hi", F.col("left"), closed=True), "i1": x.count("lo", F.col("right")) - 1})
    pieces = x.spread(signed, "i0", "i1", "i", x_lo="lo", x_hi="hi")
    slope = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    y_at = lambda at: F.when(at == F.col("ax"), F.col("ay")).when(at == F.col("bx"), F.col("by")).otherwise(F.col("ay") + (at - F.col("ax")) * slope)
    pieces = pieces.withColumns({"p": F.greatest("left", "x_lo"), "q": F.least("right", "x_hi")})
    pieces = pieces.select("place_id", "i", y_at(F.col("p")).alias("yp"), y_at(F.col("q")).alias("yq"), ((F.col("q") - F.col("p")) * F.col("sign") * F.signum(F.col("bx") - F.col("ax"))).alias("run"))
    low, high = F.least("yp", "yq"), F.greatest("yp", "yq")
    pieces = pieces.withColumns({"j0": y.count("hi", low, closed=True), "j1": y.count("lo", high) - 1}).withColumn("last", F.greatest("j0", "j1"))
    met = y.spread(pieces, "j0", "last", "j", y_lo="lo", y_hi="hi")  # j0 may lie above the axis: its cells' sides are null
    inside = F.when(F.col("j") <= F.col("j1"), F.col("run") * _clipped(F.col("yp"), F.col("yq"), F.col("y_lo"), F.col("y_hi"))).otherwise(0.0)
    border = met.select("place_id", "i", "j", F.coalesce(inside, F.lit(0.0)).alias("part"), F.when(F.col("j") == F.col("j0"), F.col("run")).otherwise(0.0).alias("run"), F.lit(False).alias("wanted"))
    asked = cells.select("place_id", "i", "j", F.lit(0.0).alias("part"), F.lit(0.0).alias("run"), F.lit(True).alias("wanted"))
    whole = border.unionByName(asked).groupBy("place_id", "i", "j").agg(F.sum("part").alias("part"), F.sum("run").alias("run"), F.max("wanted").alias("wanted"))
    above = F.sum("run").over(Window.partitionBy("place_id", "i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1))  # a column has as many rows as the axis, at most
    whole = whole.withColumn("above", F.coalesce(above, F.lit(0.0))).where("wanted")
    side = lambda of, axis, k: F.get(axis.vector(of), F.col(k))
    height = F.sin(F.radians(side("hi", y, "j"))) - F.sin(F.radians(side("lo", y, "j")))
    whole = whole.select("place_id", "i", "j", side("centre", x, "i").alias("lon"), side("centre", y, "j").alias("lat"), (F.col("part") + F.col("above") * height).alias("area"), ((side("hi", x, "i") - side("lo", x, "i")) * height).alias("full"))
    return whole.where("area > 1e-12 * full").select("place_id", "i", "j", "lon", "lat", F.least(F.lit(1.0), F.col("area") / F.col("full")).alias("weight"))


def covered_share(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """The share of each cell (place_id, i, j, lon, lat, x_lo, x_hi, y_lo, y_hi) that the place's parts cover: place_id, i, j, lon, lat, weight.

    The cells' own columns and rows are the axes, whatever their numbers are.
    """
    side = lambda centre, axis: cells.select(F.col(centre).alias("centre"), F.col(f"{axis}_lo").alias("lo"), F.col(f"{axis}_hi").alias("hi")).distinct()
    x, y = _indexes(side("lon", "x"), side("lat", "y"))
    ranked = cells.select("place_id", F.col("i").alias("i_"), F.col("j").alias("j_"), x.count("lo", F.col("x_lo")).alias("i"), y.count("lo", F.col("y_lo")).alias("j"))
    shares = _swept(edges, ranked, x, y)
    return shares.join(ranked, ["place_id", "i", "j"]).select("place_id", F.col("i_").alias("i"), F.col("j_").alias("j"), "lon", "lat", "weight")


def grid_mask(edges: DataFrame, lon: DataFrame, lat: DataFrame, weights: bool = True) -> DataFrame:
    """Cells of a lattice (columns ``centre``) covered by places: place_id, latitude, longitude, weight.

    With weights, cells inside and their eight neighbours count by the share that the place covers; a
    place without any cell centre inside takes the cells that its parts' boxes touch. By place, latitude and longitude.
    """
    x, y = _indexes(axis_edges(lon), axis_edges(lat))
    named = lambda df, weight: df.select("place_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), weight.alias("weight")).orderBy("place_id", "latitude", "longitude")
    if not weights:
        return named(_scan(edges, x, y), F.lit(1.0))
    spans = _spans(edges, x, y)  # read twice, from one shuffle of the crossings
    beside = lambda a, b, n: F.sequence(F.greatest(a - 1, F.lit(0)), F.least(b + 1, F.lit(n - 1)))
    around = spans.select("place_id", beside(F.col("i0"), F.col("i1"), len(x.centre)).alias("is"), F.explode(beside(F.col("j"), F.col("j"), len(y.centre))).alias("j")).select("place_id", F.explode("is").alias("i"), "j")
    missed = part_boxes(edges).join(spans.select("place_id").distinct(), "place_id", "left_anti")
    ends = {"i0": x.count("hi", F.col("x0")), "i1": x.count("lo", F.col("x1"), closed=True) - 1, "j0": y.count("hi", F.col("y0")), "j1": y.count("lo", F.col("y1"), closed=True) - 1}
    seeds = x.spread(y.spread(missed.withColumns(ends), "j0", "j1", "j"), "i0", "i1", "i").select("place_id", "i", "j")
    return named(_swept(edges, around.unionByName(seeds), x, y), F.col("weight"))


_held: OrderedDict[tuple[str, str], DataFrame] = OrderedDict()
#: Masks that a session keeps; the one that was asked for longest ago goes first.
MOST_HELD = 32


def held_mask(spark: SparkSession, key: str, build: Callable[[], DataFrame], most_rows: int = 1_000_000) -> DataFrame:
    """The mask of a key (``functions.columns.mask_key`` of its place, lattice and method), computed once in a session.

    A mask of at most ``most_rows`` rows is kept in memory and has a broadcast hint; a larger one is kept
    without the hint. An evicted mask is unpersisted.
    """
    at = (spark.sparkContext.applicationId, key)
    if at not in _held:
        kept = build().persist()
        few = kept.limit(most_rows + 1).count() <= most_rows
        _held[at] = F.broadcast(kept) if few else kept
        while len(_held) > MOST_HELD:
            _held.popitem(last=False)[1].unpersist()
    _held.move_to_end(at)
    return _held[at]


def lobes(boxes: DataFrame) -> DataFrame:
    """Parts' boxes (place_id, part, x0, y0, x1, y1) grouped by the side of the antimeridian, where a place spans it."""
    place = Window.partitionBy("place_id")
    wide = F.max("x1").over(place) - F.min("x0").over(place) > 180
    side = F.when(~wide, "").when((F.col("x0") + F.col("x1")) / 2 < 0, ":W").otherwise(":E")
    tagged = boxes.withColumn("lobe_id", F.concat("place_id", side))
    return tagged.groupBy("place_id", "lobe_id").agg(F.min("x0").alias("west"), F.min("y0").alias("south"), F.max("x1").alias("east"), F.max("y1").alias("north"), F.count("*").alias("n_parts"))


def union_bbox(boxes: DataFrame, by: str = "place_id") -> DataFrame:
    """The least box on the circle of longitudes that holds a group's boxes; west > east where it crosses 180.

    Boxes (west, south, east, north) that cross are cut in two; spans that touch merge; the widest gap is
    left out, and of equal gaps the one across 180.
    """
    pieces = F.when(F.col("west") <= F.col("east"), F.array(F.struct(F.col("west").alias("a"), F.col("east").alias("b")))).otherwise(
        F.array(F.struct(F.col("west").alias("a"), F.lit(180.0).alias("b")), F.struct(F.lit(-180.0).alias("a"), F.col("east").alias("b")))
    )
    spans = boxes.select(by, F.explode(pieces).alias("s")).select(by, "s.a", "s.b")
    order = Window.partitionBy(by).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("reach", reach).withColumn("gap", F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach")), F.col("a") - F.col("reach")))
    group = starts.groupBy(by).agg(F.min("a").alias("first"), F.max("b").alias("last"), F.max(F.when(F.col("gap").isNotNull(), F.struct(F.col("gap"), (-F.col("a")).alias("neg"), F.col("reach")))).alias("widest"))
    across = F.col("first") + 360 - F.col("last")
    inner = F.col("widest").isNotNull() & (F.col("widest.gap") > across)
    rows = boxes.groupBy(by).agg(F.min("south").alias("south"), F.max("north").alias("north"))
    return group.join(rows, by).select(by, F.when(inner, -F.col("widest.neg")).otherwise(F.col("first")).alias("west"), "south", F.when(inner, F.col("widest.reach")).otherwise(F.col("last")).alias("east"), "north")
