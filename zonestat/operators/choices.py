"""Choices before and after a statistic: which targets and places, which frame and box, which lattice, in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import no_nan, normal_longitude
from . import mask as M

#: Order of results, by the columns that one has.
ORDER = ("place_id", "station", "year", "date", "month", "band", "class", "latitude", "longitude", "depth")


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """A result in the order of its keys (masks by latitude, then longitude); ``first`` are other columns that go before."""
    return rows.orderBy(*first, *[c for c in ORDER if c in rows.columns and c not in first])


def select_targets(
    targets: DataFrame, places: DataFrame, datasets: tuple[str, ...] = (), variables: tuple[str, ...] = (), wanted: tuple[str, ...] = (), named: bool = False, days: str | None = None,
    default_days: str = "all",
) -> DataFrame:
    """What a run computes: dataset, variable, place_id, days.

    ``targets`` has dataset, variable, rule (all, nms or list), places (for list) and days (a number or all, or null);
    ``places`` has place_id. A rule meets the places that it admits by an equality join. Empty filters admit all. Where the run
    is ``named``, its wanted places are taken for every target as they are, each once. ``days`` of the run go before a target's.
    """
    kept = targets
    for column, values in (("dataset", datasets), ("variable", variables)):
        kept = kept.where(F.col(column).isin(list(values))) if values else kept
    kept = kept.withColumn("days", F.coalesce(F.lit(days), "days", F.lit(default_days)))
    columns = ["dataset", "variable", "place_id", "days"]
    if named:
        ids = F.array(*[F.lit(p) for p in dict.fromkeys(wanted)]).cast("array<string>")
        return kept.withColumn("place_id", F.explode(ids)).select(columns)
    nms = F.when(F.col("place_id").startswith("NMS:"), F.array(F.lit("all"), F.lit("nms"))).otherwise(F.array(F.lit("all")))
    by_rule = kept.where("rule <> 'list'").join(places.select("place_id").distinct().select("place_id", F.explode(nms).alias("rule")), "rule").select(columns)
    by_list = kept.where("rule = 'list'").withColumn("place_id", F.explode("places")).select(columns)
    both = by_rule.unionByName(by_list)
    return both.where(F.col("place_id").isin(list(wanted))) if wanted else both


def native_name(name: Column, reserved: tuple[str, ...]) -> Column:
    """A source's own column name; one that a reserved name equals but for case gets ``_src``."""
    return F.when(F.lower(name).isin([r.lower() for r in reserved]), F.concat(name, F.lit("_src"))).otherwise(name)


def frame_choice(cells: DataFrame, by: str = "place_id", lon: str = "longitude") -> DataFrame:
    """By group, the centre of the frame in which its cells don't wrap: 180 where they span over half the globe, else 0."""
    x = normal_longitude(no_nan(F.col(lon)))
    return cells.groupBy(by).agg(F.when(F.max(x) - F.min(x) > 180, 180).otherwise(0).alias("centre"))


def map_bounds(places: DataFrame, vertices: DataFrame) -> DataFrame:
    """Boxes to fit a map to (place_id, west, south, east, north).

    A box (x0, y0, x1, y1) of at most 180 degrees is taken as it is; only of wider places are the vertices (place_id, lon, lat)
    read, from 0 to 360. A place without vertices keeps its box.
    """
    wide = places.where(F.col("x1") - F.col("x0") > 180).select("place_id")
    lon, lat = normal_longitude(no_nan(F.col("lon")), 180), no_nan(F.col("lat"))
    box = vertices.join(wide, "place_id", "left_semi").groupBy("place_id").agg(F.min(lon).alias("w"), F.min(lat).alias("s"), F.max(lon).alias("e"), F.max(lat).alias("n"))
    found = places.join(box, "place_id", "left")
    pick = lambda a, b: F.when(F.col("w").isNotNull() & F.col("s").isNotNull(), F.col(a)).otherwise(F.col(b))
    return found.select("place_id", pick("w", "x0").alias("west"), pick("s", "y0").alias("south"), pick("e", "x1").alias("east"), pick("n", "y1").alias("north"))


def axis_table(rows: DataFrame, axis: str, low: float, high: float, descending: bool = False) -> DataFrame:
    """The distinct values of an axis between bounds, in its direction: the bounds reach the scan as filters."""
    values = rows.where(F.col(axis).between(low, high)).select(axis).distinct()
    return values.orderBy(F.col(axis).desc() if descending else F.col(axis))


def snap_lattice(transforms: DataFrame, res: float) -> DataFrame:
    """Origins (x0, y0) and steps (dx, dy) set to a lattice of step ``res``; on_grid is false where they were not near it.

    Near: the origin within a tenth of a step, the steps within 1e-5; the caller refuses others.
    """
    x, y = F.bround(F.col("x0") / res) * res, F.bround(F.col("y0") / res) * res
    off = (F.abs(x - F.col("x0")) > res / 10) | (F.abs(y - F.col("y0")) > res / 10) | (F.abs(F.abs("dx") - res) > 1e-5) | (F.abs(F.abs("dy") - res) > 1e-5)
    return transforms.withColumns({"on_grid": ~off, "x0": F.round(x, 6), "y0": F.round(y, 6), "dx": F.lit(res), "dy": F.lit(-res)})


def same_lattice(a: DataFrame, b: DataFrame, key: str, width: int, tolerance: float = 0.01) -> DataFrame:
    """By key, whether two lattices (x0, y0, dx, dy) agree within a share of a pixel, at the origin and ``width`` pixels on."""
    step = F.abs(F.col("a.dx"))
    far = lambda o, d: F.abs((F.col(f"a.{o}") + F.col(f"a.{d}") * width) - (F.col(f"b.{o}") + F.col(f"b.{d}") * width)) / step
    near = lambda o: F.abs(F.col(f"a.{o}") - F.col(f"b.{o}")) / step
    return a.alias("a").join(b.alias("b"), key).select(key, (F.greatest(near("x0"), near("y0"), far("x0", "dx"), far("y0", "dy")) <= tolerance).alias("same"))


def sampled_share(edges: DataFrame, lon: DataFrame, lat: DataFrame, split: int = 20) -> DataFrame:
    """The share of each cell inside a place by the centres of split x split parts of it: place_id, i, j, weight.

    The rows of the finer lattice are filled between crossings, so its cells are made inside places alone.
    """
    def finer(axis: DataFrame) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), F.lit(split - 1))).alias("k")
        cells = M.axis_edges(axis).select("i", "lo", "hi", k)
        return cells.select((F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") + 0.5) / split).alias("centre"))

    fine = M.inside_scan(edges, M.axis_edges(finer(lon)), M.axis_edges(finer(lat)))
    cell = [F.floor(F.col(c) / split).cast("long").alias(c) for c in ("i", "j")]
    return fine.groupBy("place_id", *cell).agg((F.count("*") / float(split * split)).alias("weight"))


def with_daily_mean(series: DataFrame, external: DataFrame, name: str = "mean_external") -> DataFrame:
    """Series rows with another source's mean of their date, null where it has none.

    ``external`` has date, mean and ord; of rows of one date the last by ord that has a value counts, so no row is repeated.
    """
    last = Window.partitionBy("date").orderBy(F.col("ord").desc(), F.col("mean").desc())
    values = external.withColumn("mean", no_nan(F.col("mean"))).where("mean is not null")
    one = values.withColumn("at", F.row_number().over(last)).where("at = 1").select("date", F.col("mean").alias(name))
    return series.join(one, "date", "left")


def year_contents(valid: DataFrame) -> DataFrame:
    """By place and year: bands with valid pixels, and whether the year is empty; ``valid`` as in ``series.now_choice``."""
    return valid.groupBy("place_id", "year").agg(F.count_if(F.coalesce("n", F.lit(0)) > 0).alias("days")).withColumn("empty", F.col("days") == 0)


def lattice_axes(rasters: DataFrame) -> DataFrame:
    """Pixel centres of rasters (place_id, width, height, west, south, east, north): place_id, axis, k, centre; rows run from north to south."""
    dx, dy = (F.col("east") - F.col("west")) / F.col("width"), (F.col("north") - F.col("south")) / F.col("height")
    along = lambda name, n, at: rasters.withColumn("k", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))).select("place_id", F.lit(name).alias("axis"), "k", at.alias("centre"))
    return along("lon", "width", F.col("west") + (F.col("k") + 0.5) * dx).unionByName(along("lat", "height", F.col("north") - (F.col("k") + 0.5) * dy))


def on_lattice(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    """Mask cells (place_id, longitude, latitude, weight) as pixels of their place's raster: place_id, row, col, weight; cells outside are left out."""
    col = F.floor((F.col("longitude") - F.col("west")) / (F.col("east") - F.col("west")) * F.col("width")).cast("int")
    row = F.floor((F.col("north") - F.col("latitude")) / (F.col("north") - F.col("south")) * F.col("height")).cast("int")
    placed = cells.join(rasters, "place_id").select("place_id", row.alias("row"), col.alias("col"), "weight", "width", "height")
    return placed.where((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") < F.col("width"))).drop("width", "height")


def spacings(cells: DataFrame, by: list[str] | None = None, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """By group, the steps of cells (dx, dy): medians of the gaps between neighbouring values; an axis with one value takes the other's step."""
    by = by or []

    def gaps(axis: str, name: str) -> DataFrame:
        values = cells.select(*by, no_nan(F.col(axis)).alias("v_")).where("v_ is not null").distinct()
        gap = F.col("v_") - F.lag("v_").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("v_"))  # an axis: few distinct values
        return values.withColumn("gap_", gap).groupBy(*by).agg(F.coalesce(F.median("gap_"), F.lit(0.0)).alias(name))

    x, y = gaps(lon, "dx"), gaps(lat, "dy")
    both = x.join(y, by) if by else x.crossJoin(y)  # one row each
    return both.select(*by, F.when(F.col("dx") > 0, F.col("dx")).otherwise(F.col("dy")).alias("dx"), F.when(F.col("dy") > 0, F.col("dy")).otherwise(F.col("dx")).alias("dy"))
