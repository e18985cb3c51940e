"""The statistics as SQL over named views: tables are identifiers, values are expressions given by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_KEYS = "round(cast(s.latitude AS double), {d}) = round(cast(m.latitude AS double), {d}) AND round(cast(s.longitude AS double), {d}) = round(cast(m.longitude AS double), {d})"
_FROM = "FROM IDENTIFIER(:slab) s JOIN IDENTIFIER(:mask) m ON " + _KEYS

TEMPLATES = {
    "stats_daily": f"""
        SELECT to_date(time) AS date, count(v) AS n, avg(v) AS mean, try_divide(sum(v * weight), sum(weight)) AS mean_wt, stddev_samp(v) AS sd, min(v) AS min, max(v) AS max,
               percentile(v, 0.1) AS p10, percentile(v, 0.9) AS p90, sum(weight) AS weight_sum
        FROM (SELECT s.time, m.weight, {{value}} AS v {_FROM.format(d=3)}) WHERE v IS NOT NULL GROUP BY 1 ORDER BY 1""",
    "stats_categorical": f"""
        SELECT date, class, n, weight, try_divide(weight, sum(weight) OVER (PARTITION BY date)) AS fraction, 100D * n / sum(n) OVER (PARTITION BY date) AS percent_cells
        FROM (SELECT to_date(time) AS date, cast(rint(v) AS bigint) AS class, count(*) AS n, sum(weight) AS weight
              FROM (SELECT s.time, m.weight, {{value}} AS v {_FROM.format(d=3)}) WHERE v IS NOT NULL GROUP BY 1, 2) ORDER BY 1, 2""",
    "stats_points": f"""
        SELECT to_date(trunc(time, 'month')) AS date, count(v) AS n, count(DISTINCT struct(time, longitude, latitude)) AS n_casts, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS min, max(v) AS max,
               percentile(v, 0.1) AS p10, percentile(v, 0.9) AS p90
        FROM (SELECT s.time, cast(s.longitude AS double) AS longitude, cast(s.latitude AS double) AS latitude, {{value}} AS v {_FROM.format(d=5)}) WHERE v IS NOT NULL GROUP BY 1 ORDER BY 1""",
    "station_means": f"""
        SELECT latitude, longitude, 1D AS weight, avg(v) AS value, count(v) AS n, to_date(max(time)) AS date
        FROM (SELECT m.latitude, m.longitude, s.time, {{value}} AS v {_FROM.format(d=5)}) WHERE v IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2""",
    "last_step": f"""
        WITH joined AS (SELECT s.time, m.latitude, m.longitude, m.weight, {{value}} AS value {_FROM.format(d=3)})
        SELECT to_date(time) AS date, latitude, longitude, weight, value FROM joined WHERE time = (SELECT max(time) FROM joined) ORDER BY 2, 3""",
}


def run_template(spark: SparkSession, name: str, slab: str, mask: str, value: str) -> DataFrame:
    """One of the statistics over views; ``value`` is an SQL expression over the slab's alias s, such as ``s.sst - 273.15D``."""
    return spark.sql(TEMPLATES[name].format(value=value), args={"slab": slab, "mask": mask})
