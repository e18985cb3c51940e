"""Statistics inside a mask, on small fixtures with known results."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonestat.functions.columns import class_code, long_format, no_nan, value_expr
from zonestat.operators import stats as A

LATS, LONS = (43.125, 43.375), (-66.875, -66.625, -66.375)
CELLS = [(lat, lon) for lat in LATS for lon in LONS]
WEIGHTS = (0.125, 1.0, 0.75, 0.5, 1.0, 0.375)
MASK = [(*c, w) for c, w in zip(CELLS, WEIGHTS, strict=True)]
MAY, JUNE = [4.5, 6.25, 5.75, 7.0, 8.5, 6.0], [9.0, 11.5, 10.25, 12.0, 12.75, 10.5]
KINDS = [7, 7, 3, 5, 3, 7]


@pytest.fixture(scope="module")
def grid(spark):
    days = ((dt.datetime(2031, 5, 30, 6), MAY), (dt.datetime(2031, 6, 2, 18), JUNE))
    rows = [(at, *c, k, v) for at, values in days for c, k, v in zip(CELLS, KINDS, values, strict=True)]
    rows.append((days[0][0], -12.5, 100.25, 1, 55.0))  # outside the mask
    slab = spark.createDataFrame(rows, "time timestamp, latitude float, longitude float, kind int, v double")
    return slab, spark.createDataFrame(MASK, "latitude double, longitude double, weight double")


def test_daily_over_a_float_axis(grid):
    slab, mask = grid
    got = {str(r["date"]): r for r in A.stats_daily(slab, mask, value_expr("v")).collect()}
    assert set(got) == {"2031-05-30", "2031-06-02"}
    for day, values in (("2031-05-30", MAY), ("2031-06-02", JUNE)):
        r = got[day]
        assert r["n"] == 6 and r["mean"] == pytest.approx(np.mean(values)) and r["sd"] == pytest.approx(np.std(values, ddof=1))
        assert r["mean_wt"] == pytest.approx(np.average(values, weights=WEIGHTS)) and r["weight_sum"] == pytest.approx(sum(WEIGHTS))
        assert (r["min"], r["max"]) == (min(values), max(values))
        assert (r["p10"], r["p90"]) == (pytest.approx(np.quantile(values, 0.1)), pytest.approx(np.quantile(values, 0.9)))


def test_kelvin(grid):
    slab, mask = grid
    got = A.stats_daily(slab, mask, value_expr("v", "K")).orderBy("date").first()
    assert got["mean"] == pytest.approx(np.mean(MAY) - 273.15)
    assert value_expr("x", "knots") is not None


def test_categories_sum_to_one(grid):
    slab, mask = grid
    rows = A.stats_categorical(slab, mask, F.col("kind")).collect()
    day = {r["class"]: r for r in rows if str(r["date"]) == "2031-05-30"}
    weight = {k: sum(w for w, x in zip(WEIGHTS, KINDS, strict=True) if x == k) for k in set(KINDS)}
    assert {k: r["n"] for k, r in day.items()} == {k: KINDS.count(k) for k in weight}
    for k, r in day.items():
        assert r["fraction"] == pytest.approx(weight[k] / sum(WEIGHTS)) and r["percent_cells"] == pytest.approx(100 * KINDS.count(k) / 6)
    assert sum(r["fraction"] for r in day.values()) == pytest.approx(1, abs=1e-12)


def test_last_step_keeps_cells_without_value(grid):
    slab, mask = grid
    holed = slab.withColumn("v", F.when((F.col("latitude") > 43.2) & (F.col("longitude") > -66.5), None).otherwise(F.col("v")))
    rows = A.last_step(holed, mask, value_expr("v")).orderBy("latitude", "longitude").collect()
    assert [(r["latitude"], r["longitude"], r["weight"]) for r in rows] == MASK
    assert [r["value"] for r in rows] == [*JUNE[:5], None] and {str(r["date"]) for r in rows} == {"2031-06-02"}


def test_nulls_leave_weights_out(grid):
    slab, mask = grid
    holed = slab.withColumn("v", F.when(F.col("kind") == 5, None).otherwise(F.col("v")))
    got = A.stats_daily(holed, mask, value_expr("v")).orderBy("date").first()
    assert (got["n"], got["weight_sum"]) == (5, pytest.approx(sum(WEIGHTS) - 0.5))


def test_points_and_stations(spark):
    at = lambda *x: dt.datetime(2015, *x)
    a, b = (34.00, -120.50), (34.10, -120.60)
    rows = [(at(1, 27, 8, 34, 10), *a, float(d), "temperature", v) for d, v in ((0, 15.0), (10, 14.0), (20, 13.0))]
    rows += [(at(1, 27, 11, 2), *b, float(d), "temperature", v) for d, v in ((0, 16.0), (10, 12.0))]
    rows += [(at(4, 14, 9), *a, 0.0, "temperature", 18.0), (at(4, 14, 9), *a, 10.0, "temperature", None), (at(1, 27, 8, 34, 10), 40.0, -60.0, 0.0, "temperature", 99.0), (at(1, 27, 8), *a, 0.0, "salinity", 33.0)]
    slab = spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, depth double, measurement_type string, measurement_value double")
    mask = spark.createDataFrame([(*a, 1.0), (*b, 1.0)], "latitude double, longitude double, weight double")
    pts = long_format(slab, "temperature")
    jan, apr = A.stats_points(pts, mask, F.col("value")).orderBy("date").collect()
    assert (str(jan["date"]), jan["n"], jan["n_casts"], jan["mean"], jan["min"], jan["max"]) == ("2015-01-01", 5, 2, 14.0, 12.0, 16.0)
    assert jan["p10"] == pytest.approx(12.4) and jan["p90"] == pytest.approx(15.6)
    assert (str(apr["date"]), apr["n"], apr["n_casts"], apr["sd"]) == ("2015-04-01", 1, 1, None)
    first, _ = A.station_means(pts, mask, F.col("value")).orderBy("latitude").collect()
    assert (first["value"], first["n"], str(first["date"]), first["weight"]) == (15.0, 4, "2015-04-14", 1.0)


def test_day_ends_at_utc_midnight(spark, grid):
    slab = spark.sql("SELECT timestamp'2031-05-30 23:59:59.999Z' AS time, float(43.125) AS latitude, float(-66.625) AS longitude, 1D AS v")
    assert str(A.stats_daily(slab, grid[1], F.col("v")).first()["date"]) == "2031-05-30"


def test_nan_and_classes(spark):
    got = spark.sql("SELECT double('NaN') AS a, 2.5D AS b, 3.5D AS c, 2.7D AS d").select(no_nan(F.col("a")), *[class_code(F.col(c)) for c in "bcd"]).first()
    assert tuple(got) == (None, 2, 4, 3)


def test_empty_slab(spark, grid):
    slab, mask = grid
    assert A.stats_daily(slab.limit(0), mask, value_expr("v")).count() == 0
    assert A.last_step(slab.limit(0), mask, value_expr("v")).count() == 0


def test_quantiles_of_groups_of_any_size(spark):
    """Ranks in a global order equal percentiles: hot groups, few distinct values, single rows, nulls."""
    rng = random.Random(2)
    rows = [("hot", k % 3, rng.gauss(0, 1)) for k in range(3000)] + [("even", 0, float(k % 4)) for k in range(41)] + [("one", 0, 7.0), ("two", 0, 1.0), ("two", 0, 2.0), ("none", 0, None), ("same", 1, 5.5), ("same", 1, 5.5)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(6)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {(r["g"], r["k"]): r for r in A.quantiles(df, ["g", "k"], "v", shares).collect()}
    want = df.where("v is not null").groupBy("g", "k").agg(*[F.percentile("v", F.lit(p)).alias(c) for c, p in shares.items()]).collect()
    assert len(got) == len(want) == 7
    for r in want:
        for c in shares:
            assert got[(r["g"], r["k"])][c] == pytest.approx(r[c], abs=1e-12)


def test_daily_statistics_of_days_of_any_size(spark):
    rng = random.Random(3)
    rows = [(dt.datetime(2026, 1, 1 + k % 3, 12), 20.0 + 0.05 * (k % 7), -160.0, rng.random() if k % 5 else None) for k in range(700)]
    slab = spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, v double")
    mask = spark.createDataFrame([(p, 20.0 + 0.05 * k, -160.0, 0.25 + 0.1 * k) for k in range(6) for p in ("a", "b")][:9], "place_id string, latitude double, longitude double, weight double")
    for m in (mask, mask.drop("place_id").distinct()):
        plain, bounded = ({(r["date"], r.asDict().get("place_id")): r for r in A.stats_daily(slab, m, F.col("v"), bounded=b).collect()} for b in (False, True))
        assert set(plain) == set(bounded) and plain
        for key, r in plain.items():
            assert bounded[key].__fields__ == r.__fields__
            assert [x for x in bounded[key] if isinstance(x, float)] == pytest.approx([x for x in r if isinstance(x, float)])
