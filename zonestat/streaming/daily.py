"""Daily statistics of slab files as they land, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators.stats import masked
from ..schemas import SLAB


def read_slabs(spark: SparkSession, path: str, schema: str = SLAB) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_daily(slabs: DataFrame, mask: DataFrame, value: Column, late: str = "2 days") -> DataFrame:
    """By UTC day: n, mean, mean_wt, sd, min, max, weight_sum. A day is final when the watermark passes its end.

    Exact percentiles would hold all values of a day in state; the batch query gives them.
    """
    rows = masked(slabs.withWatermark("time", late), mask, value)
    v, w = F.col("value"), F.col("weight")
    days = rows.groupBy(F.window("time", "1 day").alias("day")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), ratio(F.sum(v * w), F.sum(w)).alias("mean_wt"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(w).alias("weight_sum")
    )
    return days.select(F.to_date("day.start").alias("date"), "n", "mean", "mean_wt", "sd", "min", "max", "weight_sum")
