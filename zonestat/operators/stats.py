"""Statistics of a slab's cells inside a mask: the public queries of the engine.

A slab is a table with time, latitude, longitude and values; a mask has latitude, longitude and weight.
Masks are joined by rounded coordinates and may hold many places (then with ``place_id``): one pass over
the slab serves them all, and gives rows by place. ``small_side(mask)`` checks a mask's size and has it
broadcast, so that the slab isn't shuffled for the join; a larger mask is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cell_key, class_code, month_of, quantile, ratio, utc_day
from ..tables import written
from .running import running

GRID_DECIMALS, POINT_DECIMALS = 3, 5


#: Most rows of a mask that is broadcast: 32 bytes each.
SMALL_ROWS = 1_000_000


def small_side(df: DataFrame, most_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` as a table in the shared folder, with a broadcast hint if it has at most ``most_rows`` rows."""
    kept = written(df)  # nothing stays in the executors' memory
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def _places(mask: DataFrame) -> list[str]:
    return ["place_id"] if "place_id" in mask.columns else []


def _in_order(result: DataFrame, *keys: str) -> DataFrame:
    """A result by place and its keys: few rows beside the slab's. Joins and sums of it drop the order again."""
    return result.orderBy(*[c for c in ("place_id",) if c in result.columns], *keys)


def masked(slab: DataFrame, mask: DataFrame, value: Column, decimals: int = GRID_DECIMALS, drop_nulls: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Slab rows inside the mask: time, the mask's position and weight, value (and the slab's ``keep`` columns)."""
    given = slab.select(cell_key(F.col("latitude"), decimals).alias("klat"), cell_key(F.col("longitude"), decimals).alias("klon"), "time", value.alias("value"), *keep)
    if drop_nulls:
        given = given.where(F.col("value").isNotNull())
    cells = mask.select(cell_key(F.col("latitude"), decimals).alias("klat"), cell_key(F.col("longitude"), decimals).alias("klon"), F.col("latitude").cast("double"), F.col("longitude").cast("double"), F.col("weight").cast("double"), *_places(mask))
    return given.join(cells, ["klat", "klon"]).drop("klat", "klon")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """By group: exact continuous quantiles, linear between neighbours, as columns named by ``shares``; ``by`` columns aren't null.

    For groups of any size: equal values are counted before the shuffle, distinct ones are put in one global order (a group may
    span many tasks), and running counts give their ranks. No task holds a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("c_"))
    ranked = running(counts, [*by, "v_"], sums=["c_"])
    groups = ranked.groupBy(*by).agg(F.sum("c_").alias("n_"), F.min(F.col("running_c_") - F.col("c_")).alias("start_"))
    end = F.col("running_c_") - F.col("start_")
    placed = ranked.join(groups, by).withColumns({"to_": end, "from_": end - F.col("c_")})
    at = lambda rank: F.max(F.when((F.col("from_") <= rank) & (rank < F.col("to_")), F.col("v_")))
    found, out = [], []
    for name, share in shares.items():
        h = F.lit(share) * (F.col("n_") - 1)
        found += [at(F.floor(h)).alias(f"{name}_low"), at(F.ceil(h)).alias(f"{name}_high"), F.first(h - F.floor(h)).alias(f"{name}_part")]
        low, high, part = (F.col(f"{name}_{c}") for c in ("low", "high", "part"))
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    return placed.groupBy(*by).agg(*found).select(*by, *out)


def stats_daily(slab: DataFrame, mask: DataFrame, value: Column, bounded: bool = False) -> DataFrame:
    """By UTC day: n, mean, mean_wt, sd, min, max, p10, p90, weight_sum.

    An exact percentile holds a group's distinct values in one task. With ``bounded``, it comes from ``quantiles`` instead: two more
    shuffles, and days of any number of cells; joined rows are written once to the shared folder.
    """
    rows = masked(slab, mask, value).withColumn("date", utc_day(F.col("time")))
    v, w, by = F.col("value"), F.col("weight"), [*_places(mask), "date"]
    plain = [F.count(v).alias("n"), F.avg(v).alias("mean"), ratio(F.sum(v * w), F.sum(w)).alias("mean_wt"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")]
    shares = {"p10": 0.1, "p90": 0.9}
    if not bounded:
        return _in_order(rows.groupBy(*by).agg(*plain, *[quantile(v, p).alias(c) for c, p in shares.items()], F.sum(w).alias("weight_sum")), "date")
    rows = written(rows.select(*by, "value", "weight"))
    whole = rows.groupBy(*by).agg(*plain, F.sum(w).alias("weight_sum")).join(quantiles(rows, by, "value", shares), by)
    return _in_order(whole.select(*by, "n", "mean", "mean_wt", "sd", "min", "max", *shares, "weight_sum"), "date")


def stats_categorical(slab: DataFrame, mask: DataFrame, value: Column) -> DataFrame:
    """By UTC day and class: n, weight, fraction of the day's weight, percent of its cells."""
    by = [*_places(mask), "date"]
    rows = masked(slab, mask, value).select(*_places(mask), utc_day(F.col("time")).alias("date"), class_code(F.col("value")).alias("class"), "weight")
    classes = rows.groupBy(*by, "class").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    day = Window.partitionBy(*by)
    shares = classes.select(
        *by, "class", "n", "weight", ratio(F.col("weight"), F.sum("weight").over(day)).alias("fraction"), (F.lit(100.0) * F.col("n") / F.sum("n").over(day)).alias("percent_cells")
    )
    return _in_order(shares, "date", "class")


def stats_points(slab: DataFrame, mask: DataFrame, value: Column) -> DataFrame:
    """By month, of point samples: n, n_casts (distinct times and positions), mean, sd, min, max, p10, p90."""
    kept = masked(slab.withColumns({"lon_": F.col("longitude").cast("double"), "lat_": F.col("latitude").cast("double")}), mask, value, POINT_DECIMALS, keep=("lon_", "lat_"))
    rows = kept.withColumn("date", month_of(utc_day(F.col("time"))))
    v = F.col("value")
    months = rows.groupBy(*_places(mask), "date").agg(
        F.count(v).alias("n"), F.count_distinct(F.struct("time", "lon_", "lat_")).alias("n_casts"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"), F.max(v).alias("max"), quantile(v, 0.1).alias("p10"), quantile(v, 0.9).alias("p90"),
    )
    return _in_order(months, "date")


def station_means(slab: DataFrame, mask: DataFrame, value: Column) -> DataFrame:
    """By station: latitude, longitude, weight 1, mean value, n, the last day with a value."""
    rows = masked(slab, mask, value, POINT_DECIMALS)
    means = rows.groupBy(*_places(mask), "latitude", "longitude").agg(F.lit(1.0).alias("weight"), F.avg("value").alias("value"), F.count("value").alias("n"), utc_day(F.max("time")).alias("date"))
    return _in_order(means, "latitude", "longitude")


def last_step(slab: DataFrame, mask: DataFrame, value: Column) -> DataFrame:
    """The cells of the latest masked time; cells without a value are kept."""
    rows = masked(slab, mask, value, drop_nulls=False)
    by = _places(mask)
    last = rows.groupBy(*by).agg(F.max("time").alias("last"))
    latest = rows.join(last, by) if by else rows.crossJoin(F.broadcast(last))  # one row
    return _in_order(latest.where(F.col("time") == F.col("last")).select(*by, utc_day(F.col("time")).alias("date"), "latitude", "longitude", "weight", "value"), "latitude", "longitude")


def stations(slab: DataFrame) -> DataFrame:
    """The positions that a slab samples."""
    return slab.select("longitude", "latitude").distinct()


def without_repeats(*slabs: DataFrame) -> DataFrame:
    """The slabs of a place's lobes as one; steps that an axis snapped to twice count once."""
    whole = slabs[0]
    for s in slabs[1:]:
        whole = whole.unionByName(s)
    return whole.dropDuplicates()


def mask_summary(mask: DataFrame) -> DataFrame:
    w = F.col("weight")
    return mask.agg(F.count("*").alias("cells"), F.sum(w).alias("total_weight"), F.count_if(w < 0.999).alias("partial"))


#: Columns that a written series names otherwise than the query does.
PUBLISHED = {"fraction": "frac_area", "percent_cells": "pct_cells"}


def published(series: DataFrame) -> DataFrame:
    """Class columns by the names that written series have."""
    return series.withColumnsRenamed(PUBLISHED)


def as_queried(series: DataFrame) -> DataFrame:
    """The reverse of ``published``."""
    return series.withColumnsRenamed({v: k for k, v in PUBLISHED.items()})


def joined_lobes(*masks: DataFrame) -> DataFrame:
    """The cells of a place's lobes as one mask. Lobes that touch may both have a cell: it counts once, with its larger weight."""
    whole = masks[0]
    for m in masks[1:]:
        whole = whole.unionByName(m)
    keys = [c for c in whole.columns if c != "weight"]
    return whole.groupBy(*keys).agg(F.max("weight").alias("weight"))
