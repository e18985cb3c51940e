"""Series, cubes, chunk plans and merges."""

import datetime as dt
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from zonestat.functions.columns import band_day, band_of, spacing_days, step_band, step_label
from zonestat.operators import incremental as I
from zonestat.operators import series as S
from zonestat.operators.incremental import Span


@pytest.fixture(scope="module")
def daily(spark):
    rows = []
    day = date(2020, 1, 1)
    while day.year < 2026:
        band = date(2000, day.month, day.day).timetuple().tm_yday
        rows.append((day, round(27 + 3 * math.sin(2 * math.pi * (band - 120) / 366) + 0.1 * (day.year - 2020), 4)))
        day += dt.timedelta(1)
    return spark.createDataFrame(rows, "date date, mean double")


def test_series(daily):
    got = S.series_by_day(daily, (2020, 2022))
    assert got.count() == 6 * 365 + 2
    assert got.where("band = 60 and year = 2021").count() == 0
    assert {r["band"] for r in got.where("month(date) = 3 and day(date) = 1").select("band").collect()} == {61}
    anomaly = got.where("year = 2025").agg(F.avg("anom")).first()[0]
    assert anomaly == pytest.approx(0.4, abs=0.01)
    assert S.series_by_day(daily, (2020, 2022), smooth=7).count() == 6 * 365 + 2


def test_calendar(spark):
    row = spark.sql("SELECT date'2021-03-01' AS a, date'2020-02-29' AS b, 2021 AS y, 60 AS n").select(band_of(F.col("a")), band_of(F.col("b")), band_day(F.col("y"), F.col("n")), step_band(F.lit(1), -1)).first()
    assert tuple(row) == (61, 60, None, 366)


@pytest.mark.parametrize(("text", "days", "label"), [("8 days 0h 7m 57s", 8.0055, "8-day"), ("1 day", 1, "daily"), ("12h", 0.5, "sub-daily"), ("30 days", 30, "monthly"), ("", None, None)])
def test_spacing(spark, text, days, label):
    got = spark.createDataFrame([(text,)], "t string").select(spacing_days(F.col("t")).alias("d")).select("d", step_label(F.col("d"))).first()
    assert got[0] == (pytest.approx(days, abs=1e-3) if days else None) and got[1] == label


@pytest.fixture(scope="module")
def cube(spark):
    cells = spark.range(400).select((F.expr("id div 20")).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    days = spark.createDataFrame([(y, b) for y in (2024, 2025) for b in (59, 60, 61, 200)], "year int, band int")
    value = 20 + F.col("band") * 0.01 + (F.col("year") - 2024) * 0.5 + F.col("col") * 0.1 - F.col("row") * 0.05
    nodata = (F.col("row") + F.col("col") < 3) | ((F.col("band") == 60) & (F.col("year") == 2025))
    return cells.crossJoin(days).withColumn("value", F.when(nodata, float("nan")).otherwise(value)).withColumn("place_id", F.lit("p"))


def test_climatology_and_exceedance(cube):
    clim = S.climatology(cube)
    leap = clim.where("band = 60 and row = 5 and col = 5").first()
    assert (leap["n"], leap["sd"]) == (1, None)
    assert clim.where("band = 200 and row = 5 and col = 5").first()["mean"] == pytest.approx(20 + 2 + 0.25 + 0.5 - 0.25)
    assert clim.where("band = 200 and row = 0 and col = 0").first()["mean"] is None
    change = cube.where("band = 200").groupBy("place_id", "row", "col").agg((F.max(F.when(F.col("year") == 2025, F.col("value"))) - F.max(F.when(F.col("year") == 2024, F.col("value")))).alias("anom"))
    got = S.exceedance(change, 0.4, (-81.0, 24.5, -80.0, 25.5), 20, 20).first()
    assert (got["n"], got["valid"]) == (394, 394)


def test_pooling_goes_round_the_year(spark):
    rows = [("p", 2024, 366, 0, 0, 10.0), ("p", 2024, 1, 0, 0, 20.0)]
    cube = spark.createDataFrame(rows, "place_id string, year int, band int, row int, col int, value double")
    got = {r["band"]: r["mean"] for r in S.climatology(cube, pool=1).collect()}
    assert got == {365: 10.0, 366: 15.0, 1: 15.0, 2: 20.0}


@pytest.mark.parametrize("pool", [0, 1, 4, 182])
def test_pooled_moments_by_force(spark, pool):
    """Every band within reach of a row, over sparse and dense years, values far from zero."""
    rng = random.Random(pool)
    rows = []
    for pixel in range(3):
        bands = list(range(1, 367)) if pixel == 0 else sorted(rng.sample(range(1, 367), 5 if pixel == 1 else 60))
        for year in (2001, 2002, 2003):
            rows += [("p", year, b, pixel, 7, rng.choice([None, float("nan"), 1e6 + rng.random()])) for b in bands if rng.random() < 0.9]
    got = {(r["row"], r["band"]): r for r in S.climatology(spark.createDataFrame(rows, "place_id string, year int, band int, row int, col int, value double"), pool=pool).collect()}
    want = {}
    for _, _, band, row, _, value in rows:
        for shift in range(-pool, pool + 1):
            want.setdefault((row, (band - 1 + shift) % 366 + 1), []).append(value)
    assert set(got) == set(want)
    for key, values in want.items():
        known = [v for v in values if v is not None and v == v]
        r = got[key]
        assert r["n"] == len(known)
        mean = sum(known) / len(known) if known else None
        assert r["mean"] == (None if mean is None else pytest.approx(mean, rel=1e-12))
        assert r["sd"] == (None if len(known) < 2 else pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in known) / (len(known) - 1)), abs=1e-6))


def test_a_missing_year_is_an_error_and_the_cube_is_read_once(spark, cube):
    with pytest.raises(Exception, match="lacks years .2026"):
        S.climatology(cube, (2024, 2026)).collect()
    assert S.climatology(cube, (2024, 2025)).count() == S.climatology(cube).count()
    assert S.mean_of_years(cube, 200, (2024, 2026)).count() == 400
    plan = S.climatology(cube, pool=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    with pytest.raises(ValueError):
        S.climatology(cube, pool=183)


W = Span(date(2026, 1, 1), date(2026, 4, 17))


def spans(text):
    parse = lambda s: Span(*[date(2026, *map(int, d.split("-"))) for d in s.split("_")])
    return [parse(s) for s in text.split()]


def work(spark, days, done, window=W):
    rows = [("u", name, s.start if s else None, s.end if s else None) for name, s in done.items()]
    files = spark.createDataFrame(rows, "unit string, file string, start date, end date")
    got = I.chunk_work(files, spark.createDataFrame([("u", window.start, window.end)], "unit string, start date, end date"), days)
    return {(r["action"], r["file"], r["start"], r["end"]) for r in got.collect()}


def by_force(days, done, window):
    """Day by day: what no kept file holds, cut into parts."""
    inside = {f: s for f, s in done.items() if s and window.start <= s.start and s.end <= window.end}
    out = {("remove", f, s and s.start, s and s.end) for f, s in done.items() if f not in inside}
    if inside:
        tip = max(s.end for s in inside.values())
        last = [f for f, s in inside.items() if s.end == tip]
        if len(last) == 1 and tip < window.end and inside[last[0]].days < days:
            s = inside.pop(last[0])
            out.add(("replace", last[0], s.start, s.end))
    out |= {("keep", f, s.start, s.end) for f, s in inside.items()}
    held = {s.start + dt.timedelta(k) for s in inside.values() for k in range(s.days)}
    run = []
    for k in range(window.days + 1):
        day = window.start + dt.timedelta(k)
        if k == window.days or day in held or len(run) == days:
            out |= {("fetch", None, run[0], run[-1])} if run else set()
            run = []
        if k < window.days and day not in held:
            run.append(day)
    return out


def test_chunk_work(spark):
    rng = random.Random(4)
    window = Span(date(2031, 5, 3), date(2031, 9, 20))
    for days in (14, 45):
        done = {"notes": None, "before": Span(date(2031, 4, 20), date(2031, 5, 9))}
        assert work(spark, days, done, window) == by_force(days, done, window)
        for k in range(rng.randrange(2, 6)):
            start = window.start + dt.timedelta(rng.randrange(120))
            done[f"f{k}"] = Span(start, start + dt.timedelta(rng.randrange(1, days + 3)))
        assert work(spark, days, done, window) == by_force(days, done, window)
    short = {"a": Span(window.start, date(2031, 6, 16)), "b": Span(date(2031, 6, 17), date(2031, 6, 30))}
    assert ("replace", "b", date(2031, 6, 17), date(2031, 6, 30)) in work(spark, 45, short, window)
    assert work(spark, 45, {"all": window}, window) == {("keep", "all", window.start, window.end)}


def test_chunk_days():
    assert I.chunk_days(2000) == 50 and I.chunk_days(0, 30) == 2700 and I.chunk_days(10**6) == 1


def test_gap_table(spark):
    done = spark.createDataFrame([("u", s.start, s.end) for s in spans("01-01_01-30 03-02_03-31 04-01_04-17")], "unit string, start date, end date")
    windows = spark.createDataFrame([("u", W.start, W.end), ("v", W.start, W.end)], "unit string, start date, end date")
    got = sorted((r["unit"], r["start"], r["end"]) for r in I.gaps(done, windows).collect())
    assert got == [("u", date(2026, 1, 31), date(2026, 3, 1)), ("v", W.start, W.end)]


def chunk(spark, *parts):
    rows = [(date(2026, m, d), int(v), float(v), *spans(s)[0].__dict__.values()) for s, m, values in parts for d, v in values]
    return spark.createDataFrame(rows, "date date, n long, mean double, span_start date, span_end date")


def test_assemble_takes_each_day_from_its_own_span(spark):
    rows = chunk(spark, ("01-01_01-04", 1, [(1, 1), (2, 2), (3, 3), (5, 5.000000000000001)]), ("01-05_01-07", 1, [(5, 5), (6, 6), (7, 7)]))
    got = I.assemble(rows, {"place_id": "p"}).orderBy("date").collect()
    assert [(r["date"].day, r["mean"], r["place_id"]) for r in got] == [(d, float(d), "p") for d in (1, 2, 3, 5, 6, 7)]
    rows = chunk(spark, ("03-01_03-04", 3, [(d, d) for d in (1, 2, 3, 4)]), ("03-03_03-05", 3, [(3, 3.5), (4, 4.5), (5, 5)]))
    assert [r["mean"] for r in I.assemble(rows, {}).orderBy("date").collect()] == [1, 2, 3, 4, 5]


def test_read_plans():
    have = Span(date(2020, 1, 1), date(2026, 4, 10))
    assert I.plan_read(True, True, have, W).series == "materialised"
    assert I.plan_read(True, True, have, W, date(2026, 4, 12)).slice == date(2026, 4, 12)
    assert I.plan_read(True, True, Span(date(2026, 2, 1), have.end), W).series == "live"
    assert I.plan_read(False, True, have, W).series == "live"
    assert I.cap_start(W, 90) == date(2026, 1, 18) and I.cap_start(W, 90, have) == W.start
    assert I.clamp_window(Span(date(2027, 1, 1), date(2027, 2, 1)), have)[0] == Span(date(2026, 3, 12), have.end)
