"""Day-of-year series, climatologies and raster cubes on the 366-band calendar.

A cube is a tall table: place_id, year, band, row, col, value. It is meant to be written by place and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import band_of, no_nan, ratio, step_band


def series_by_day(series: DataFrame, then: tuple[int, int], smooth: int = 0, date: str = "date", value: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """year, band, date, value (smoothed by rows inside its year), clim of the Then years, anom."""
    k = max(1, round(smooth))
    rows = series.select(*by, F.col(date).cast("date").alias("date"), F.col(value).cast("double").alias("value"))
    rows = rows.withColumns({"year": F.year("date").cast("long"), "band": band_of(F.col("date"))})
    if k > 1:
        near = Window.partitionBy(*by, "year").orderBy("date").rowsBetween(-((k) // 2), (k - 1) // 2)
        rows = rows.withColumn("value", F.avg("value").over(near))
    clim = rows.where(F.col("year").between(*then)).groupBy(*by, "band").agg(F.avg("value").alias("clim"))
    joined = rows.join(clim, [*by, "band"], "left")  # at most 366 rows a place: Spark broadcasts it where that is small
    return joined.select(*by, "year", "band", "date", "value", "clim", (F.col("value") - F.col("clim")).alias("anom")).orderBy(*by, "year", "band")


def cube_bands(pixels: DataFrame, date: str = "date") -> DataFrame:
    """Pixels (place_id, row, col, date, value) on the leap calendar; a band that repeats in a year takes the latest time."""
    rows = pixels.select("place_id", F.year(date).cast("int").alias("year"), band_of(F.col(date)).cast("int").alias("band"), "row", "col", F.col(date).alias("at"), no_nan(F.col("value")).alias("value"))
    return rows.groupBy("place_id", "year", "band", "row", "col").agg(F.max_by("value", "at").alias("value"))


_PIXEL = ["place_id", "row", "col"]


def _moments(rows: DataFrame) -> DataFrame:
    """By pixel and band over years: n, mean and the sum of squares about it."""
    v = F.col("value")
    return rows.groupBy(*_PIXEL, "band").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("squares"))


def _pooled(moments: DataFrame, pool: int) -> DataFrame:
    """Moments of the bands within ``pool`` days each side, round the year, by a window over each pixel's bands.

    The first and last bands of a year are repeated beyond its ends; bands of which only a neighbour has pixels are put in between.
    Squares are put together about the pixel's own mean, so that no digits are lost.
    """
    if not 0 < pool <= 182:
        raise ValueError("bands are pooled over 1 to 182 days each side")
    band = F.col("band")
    turns = F.filter(F.array(F.lit(0), F.lit(366), F.lit(-366)), lambda t: (t == 0) | ((t > 0) & (band <= pool)) | ((t < 0) & (band > 366 - pool)))
    round_ = moments.withColumn("band", F.explode(F.transform(turns, lambda t: band + t)))
    pixel = Window.partitionBy(*_PIXEL)
    beside = lambda f, far: F.coalesce(f("band").over(pixel.orderBy("band")), band + far).cast("int")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    fuller = round_.withColumns({"last": beside(F.lag, -2 * pool - 1), "next": beside(F.lead, 2 * pool + 1), "centre": F.avg("mean").over(pixel)})
    left, right = span(F.greatest(F.col("last") + pool + 1, band - pool), band - 1), span(band + 1, F.least(F.col("next") - 1, band + pool))
    fuller = fuller.withColumn("at", F.explode(F.concat(left, F.array(band), right)))
    own = F.col("at") == band
    some = lambda c: F.when(own & (F.col("n") > 0), c).otherwise(F.lit(0.0))
    off = F.col("mean") - F.col("centre")
    parts = fuller.select(*_PIXEL, F.col("at").alias("band"), "centre", F.when(own, F.col("n")).otherwise(0).alias("n"), some(F.col("n") * off).alias("s1"), some(F.col("squares") + F.col("n") * off * off).alias("s2"))
    near = pixel.orderBy("band").rangeBetween(-pool, pool)
    sums = parts.select(*_PIXEL, "band", "centre", *[F.sum(c).over(near).alias(c) for c in ("n", "s1", "s2")]).where(F.col("band").between(1, 366))
    n = F.col("n")
    mean = F.col("centre") + F.try_divide("s1", n)
    return sums.select(*_PIXEL, "band", n, mean.alias("mean"), F.greatest(F.lit(0.0), F.col("s2") - F.try_divide(F.col("s1") * F.col("s1"), n)).alias("squares"))


def _complete(cube: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Rows of the years; a place that lacks one of them is an error."""
    rows = cube.where(F.col("year").between(*years))
    have = rows.groupBy("place_id").agg(F.array_sort(F.collect_set(F.col("year").cast("int"))).alias("have"))  # a row for each place
    lacks = F.array_except(F.sequence(F.lit(years[0]), F.lit(years[1])), F.col("have"))
    told = F.when(F.size(lacks) > 0, F.raise_error(F.concat(F.col("place_id"), F.lit(" lacks years "), lacks.cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.join(have.select("place_id", told.alias("whole")), "place_id").where("whole").drop("whole")


def climatology(cube: DataFrame, years: tuple[int, int] | None = None, pool: int = 0, complete: bool = True) -> DataFrame:
    """By place, band and pixel: mean, sd (null under two values) and n over years, pooled over ``pool`` days each side.

    The cube is read once, whatever ``pool`` is: years become moments of each band, and those are pooled. With ``complete``
    a place that lacks one of ``years`` is an error.
    """
    rows = cube if not years else _complete(cube, years) if complete else cube.where(F.col("year").between(*years))
    found = _moments(rows.withColumn("value", no_nan(F.col("value"))).withColumn("band", F.col("band").cast("int")))
    found = _pooled(found, pool) if pool else found
    n = F.col("n")
    sd = F.when(n > 1, F.sqrt(F.col("squares") / (n - 1)))
    return found.select("place_id", F.col("band").cast(cube.schema["band"].dataType).alias("band"), "row", "col", "mean", sd.alias("sd"), "n")


def mean_of_years(cube: DataFrame, band: int, years: tuple[int, int]) -> DataFrame:
    """A custom Then: the mean of one band over years; years without that band don't count."""
    return climatology(cube.where(F.col("band") == band), years, complete=False).select("place_id", "row", "col", "mean", "n")


def anomaly(cube: DataFrame, clim: DataFrame, lattices: tuple[DataFrame, DataFrame] | None = None, width: int = 1) -> DataFrame:
    """Each pixel less its climatology on the same lattice.

    ``lattices`` are those of both (place_id, x0, y0, dx, dy): a place whose two differ by over a hundredth of a pixel, at its origin
    or ``width`` pixels on, is an error.
    """
    if lattices:
        from .choices import same_lattice

        refused = F.raise_error(F.concat(F.col("place_id"), F.lit(": the lattices differ"))).cast("boolean")
        told = same_lattice(*lattices, "place_id", width).select("place_id", F.when(F.col("same"), True).otherwise(refused).alias("same_"))  # a row for each place
        cube = cube.join(told, "place_id").where("same_").drop("same_")
    return cube.join(clim.select("place_id", "band", "row", "col", "mean"), ["place_id", "band", "row", "col"]).select(
        "place_id", "year", "band", "row", "col", (no_nan(F.col("value")) - F.col("mean")).alias("anom")
    )


def zonal_daily(cube: DataFrame, weights: DataFrame) -> DataFrame:
    """By place and band of a year, over masked pixels with a value: mean (weighted), mean_unwt, sd, min, max, n_cells, weight_sum."""
    v, w = F.col("value"), F.col("weight")
    rows = cube.withColumn("value", no_nan(F.col("value"))).where(v.isNotNull()).join(weights.select("place_id", "row", "col", "weight"), ["place_id", "row", "col"])
    return rows.groupBy("place_id", "year", "band").agg(
        ratio(F.sum(v * w), F.sum(w)).alias("mean"), F.avg(v).alias("mean_unwt"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count(v).cast("int").alias("n_cells"), F.sum(w).alias("weight_sum"),
    )


def exceedance(anomalies: DataFrame, threshold: float, bbox: tuple[float, float, float, float], width: int, height: int, by: tuple[str, ...] = ("place_id",), weight: Column | None = None) -> DataFrame:
    """Pixels above a threshold: n, valid, and the square kilometres of each, weighted by their share of the place.

    111.32 and 110.57 km (fixed values) are a degree of longitude at the equator and of latitude.
    """
    west, south, east, north = bbox
    dx, dy = (east - west) / width, (north - south) / height
    lat = F.lit(north) - (F.col("row") + 0.5) * F.lit(dy)
    area = F.lit(dx * 111.32) * F.cos(F.radians(lat)) * F.lit(dy * 110.57)
    share = weight if weight is not None else F.lit(1.0)
    rows = anomalies.withColumns({"km2_": area * share, "v_": no_nan(F.col("anom"))}).where(F.col("v_").isNotNull() & (share > 0))
    over = F.col("v_") > threshold
    return rows.groupBy(*by).agg(
        F.count_if(over).alias("n"), F.count("*").alias("valid"), F.sum(F.when(over, F.col("km2_")).otherwise(0.0)).alias("km2"), F.sum("km2_").alias("valid_km2")
    )


def band_statistics(cube: DataFrame) -> DataFrame:
    """By place, year and band: min, max, mean, population sd, percent of pixels with a value."""
    v = no_nan(F.col("value"))
    return cube.groupBy("place_id", "year", "band").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), (F.lit(100.0) * F.count(v) / F.count("*")).alias("valid_percent")
    )


def shared_domain(values: DataFrame) -> DataFrame:
    """One range for both maps (low, high), and one symmetric range for anomalies, half a degree at least."""
    return values.agg(F.min(F.least("then", "now")).alias("low"), F.max(F.greatest("then", "now")).alias("high"), F.greatest(F.lit(0.5), F.max(F.abs(F.col("now") - F.col("then")))).alias("anomaly"))


def now_choice(valid: DataFrame, year: int, band: int) -> DataFrame:
    """The latest year up to ``year`` whose band (28 February for 29 in other years) has valid pixels: (place_id, year, band).

    ``valid`` has place_id, year, band and n, the pixels with a value.
    """
    wanted = F.when(F.lit(band == 60) & ~((F.col("year") % 4 == 0) & ((F.col("year") % 100 != 0) | (F.col("year") % 400 == 0))), 59).otherwise(band)
    rows = valid.where((F.col("year") <= year) & (F.col("n") > 0) & (F.col("band") == wanted))
    return rows.groupBy("place_id").agg(F.max_by(F.struct("year", "band"), "year").alias("best")).select("place_id", "best.year", "best.band")


def chart_lines(series: DataFrame, then: tuple[int, int], now: int) -> DataFrame:
    """Series rows labelled for a chart: then, now, previous or other."""
    year = F.col("year")
    label = F.when(year == now, "now").when(year == now - 1, "previous").when(year.between(*then), "then").otherwise("other")
    return series.withColumn("line", label)


def then_line(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each band of a series by day: the Then mean, which all years' rows repeat (``by``, band, clim, line)."""
    return series.where(F.col("clim").isNotNull()).groupBy(*by, "band").agg(F.first("clim").alias("clim")).withColumn("line", F.lit("clim"))


def value_at(cube: DataFrame, points: DataFrame, bbox: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Pixel values under points (lon, lat): an equality join on the row and column that hold each."""
    west, south, east, north = bbox
    col = F.floor((F.col("lon") - west) / ((east - west) / width)).cast("int")
    row = F.floor((F.lit(north) - F.col("lat")) / ((north - south) / height)).cast("int")
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    return points.where(inside).withColumns({"row": row, "col": col}).join(cube, ["row", "col"])


def pooled_band(band: Column, by: int) -> Column:
    return step_band(band, by)
