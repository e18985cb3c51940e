"""The carrier tables as slabs, masks, series, cubes and catalog tables, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mask as M

#: Prices times this have no means that end on a five where they are rounded.
UNEVEN = 0.987654321
LON0, LAT0, STEP, NLON, NLAT = -160.0, 20.0, 0.05, 12, 16
#: A box whose sides cut cells, as west, south, east, north.
BOX = (-159.93, 20.03, -159.61, 20.52)
_square = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
PLACES = {
    "box": [[_square(*BOX)]],
    "holed": [[[(-160.01, 19.99), (-159.52, 20.11), (-159.58, 20.62), (-159.77, 20.44), (-159.96, 20.71), (-160.01, 19.99)], _square(-159.86, 20.16, -159.68, 20.33)]],
    "parts": [[_square(-159.99, 20.01, -159.83, 20.19)], [[(-159.72, 20.31), (-159.48, 20.36), (-159.61, 20.77), (-159.72, 20.31)]]],
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles to six decimals: sums depend on the order of their terms in the last bits."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on a float lattice; every seventeenth has no value."""
    e = read(spark, sf_dir, "events")
    lat = (F.lit(LAT0) + F.lit(STEP) * (F.col("user_id") % NLAT)).cast("float")
    lon = (F.lit(LON0) + F.lit(STEP) * (F.expr(f"user_id div {NLAT}") % NLON)).cast("float")
    value = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    return e.select(F.col("ts").alias("time"), lat.alias("latitude"), lon.alias("longitude"), value.alias("value"), "event_type")


SLAB = f"""slab AS (
    SELECT ts AS time, CAST({LAT0} + {STEP} * (user_id % {NLAT}) AS FLOAT) AS latitude, CAST({LON0} + {STEP} * ((user_id // {NLAT}) % {NLON}) AS FLOAT) AS longitude,
           CASE WHEN event_id % 17 <> 0 THEN value END AS value, event_type FROM events)"""


def axes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return M.axis(spark, LON0, STEP, NLON), M.axis(spark, LAT0, STEP, NLAT)


def edges(spark: SparkSession, *places: str) -> DataFrame:
    return M.edges_of(spark, {p: PLACES[p] for p in places})


AXES = f"""ax AS (SELECT i, {LON0}::DOUBLE + {STEP}::DOUBLE * i AS lon FROM range({NLON}) t(i)), ay AS (SELECT j, {LAT0}::DOUBLE + {STEP}::DOUBLE * j AS lat FROM range({NLAT}) t(j))"""
EDGES = "edges(place_id, part, px, py, qx, qy) AS (VALUES " + ", ".join(
    f"('{pid}', {p}, {ring[k][0]}::DOUBLE, {ring[k][1]}::DOUBLE, {ring[k + 1][0]}::DOUBLE, {ring[k + 1][1]}::DOUBLE)"
    for pid, parts in PLACES.items() for p, rings in enumerate(parts) for ring in rings for k in range(len(ring) - 1)
) + ")"
INSIDE = """inside AS (
    SELECT DISTINCT place_id, i, j, lon, lat FROM (
        SELECT place_id, part, i, j, lon, lat FROM ax, ay, edges
        WHERE (py > lat) <> (qy > lat) AND lon < px + (lat - py) * (qx - px) / (qy - py)
        GROUP BY ALL HAVING count(*) % 2 = 1))"""
_H = STEP / 2
BOX_MASK = f"""mask AS (
    SELECT lat AS latitude, lon AS longitude,
           greatest(0.0::DOUBLE, least(lon + {_H}, {BOX[2]}) - greatest(lon - {_H}, {BOX[0]})) / {STEP}
           * greatest(0.0::DOUBLE, sin(radians(least(lat + {_H}, {BOX[3]}))) - sin(radians(greatest(lat - {_H}, {BOX[1]})))) / (sin(radians(lat + {_H})) - sin(radians(lat - {_H}))) AS weight
    FROM ax, ay WHERE weight > 1e-9)"""
JOINED = """joined AS (
    SELECT s.*, m.latitude AS mlat, m.longitude AS mlon, m.weight FROM slab s JOIN mask m
    ON round(s.latitude::DOUBLE, 3) = round(m.latitude, 3) AND round(s.longitude::DOUBLE, 3) = round(m.longitude, 3))"""


# parcels: a place for each supplier, of slanted rings, some with a hole or a second part; its boxes stand for it where areas are compared
_SHELL = ((0.0, 0.0), (1.0, 0.13), (0.87, 1.0), (0.4, 0.62), (0.05, 0.93))
_HOLE = ((0.3, 0.2), (0.6, 0.25), (0.45, 0.5))
_SECOND = ((1.1, 0.2), (1.5, 0.3), (1.2, 0.8))
#: part, ring, corners, and which suppliers have it.
_RINGS = ((0, 0, _SHELL, "true"), (0, 1, _HOLE, "s_suppkey % 3 = 0"), (1, 0, _SECOND, "s_suppkey % 5 = 0"))
_AT = {
    "x0": f"{LON0} + {STEP} * (s_suppkey * 7 % 10) - 0.0187", "y0": f"{LAT0} + {STEP} * (s_suppkey * 3 % 11) - 0.0213",
    "dx": f"{STEP} * (1 + s_suppkey % 4) + 0.0113", "dy": f"{STEP} * (1 + s_suppkey % 6) + 0.0071",
}
_doubles = lambda text: re.sub(r"(?<![\w.])(\d+\.\d+)", r"CAST(\1 AS DOUBLE)", text)


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_id, parts."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", *[F.expr(_doubles(e)).alias(c) for c, e in _AT.items()])
    point = lambda p: F.struct((F.col("x0") + F.lit(p[0]) * F.col("dx")).alias("x"), (F.col("y0") + F.lit(p[1]) * F.col("dy")).alias("y"))
    ring = lambda corners: F.array(*map(point, (*corners, corners[0])))
    first = F.when(F.expr(_RINGS[1][3]), F.array(ring(_SHELL), ring(_HOLE))).otherwise(F.array(ring(_SHELL)))
    parts = F.when(F.expr(_RINGS[2][3]), F.array(first, F.array(ring(_SECOND)))).otherwise(F.array(first))
    return s.select(F.concat(F.lit("s"), "s_suppkey").alias("place_id"), parts.alias("parts"))


def parcel_of_boxes(spark: SparkSession, sf_dir: str, corners: tuple[tuple[float, float, float, float], ...]) -> DataFrame:
    """place_id and parts, each a box by shares of the parcel's width and height."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", *[F.expr(_doubles(e)).alias(c) for c, e in _AT.items()])
    point = lambda x, y: F.struct((F.col("x0") + F.lit(x) * F.col("dx")).alias("x"), (F.col("y0") + F.lit(y) * F.col("dy")).alias("y"))
    box = lambda w, s, e, n: F.array(F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s)))
    return s.select(F.concat(F.lit("s"), "s_suppkey").alias("place_id"), F.array(*[box(*c) for c in corners]).alias("parts"))


def parcel_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_id, x0, y0."""
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("place_id"), *[F.expr(_doubles(_AT[c])).alias(c) for c in ("x0", "y0")])


def parcel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.edges_from_parts(parcels(spark, sf_dir))


_CORNERS = ", ".join(
    f"({part}, {ring}, {k}, {', '.join(f'{v}::DOUBLE' for v in (*corners[k], *corners[(k + 1) % len(corners)]))})" for part, ring, corners, _ in _RINGS for k in range(len(corners))
)
PARCELS = f"""parcel AS (SELECT s_suppkey, 's' || s_suppkey AS place_id, {', '.join(f'{_doubles(e)} AS {c}' for c, e in _AT.items())} FROM supplier),
    corner(part, ring, k, px, py, qx, qy) AS (VALUES {_CORNERS}),
    pe AS (SELECT place_id, part, ring, k, x0 + px * dx AS px, y0 + py * dy AS py, x0 + qx * dx AS qx, y0 + qy * dy AS qy FROM parcel, corner
           WHERE ring = 0 AND part = 0 OR ring = 1 AND s_suppkey % 3 = 0 OR part = 1 AND s_suppkey % 5 = 0),
    edges AS (SELECT place_id, part, px, py, qx, qy FROM pe)"""


def slab_axes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The axes that the slab's rows lie on."""
    from ..operators.choices import axis_table

    e = read(spark, sf_dir, "events").select(F.expr(_doubles(f"{LON0} + {STEP} * (user_id div {NLAT} % {NLON})")).alias("lon"), F.expr(_doubles(f"{LAT0} + {STEP} * (user_id % {NLAT})")).alias("lat"))
    return tuple(axis_table(e, c, -360.0, 360.0).withColumnRenamed(c, "centre") for c in ("lon", "lat"))


SLAB_AXES = f"""ax AS (SELECT row_number() OVER (ORDER BY lon) - 1 AS i, lon FROM (SELECT DISTINCT {_doubles(f'{LON0} + {STEP} * (user_id // {NLAT} % {NLON})')} AS lon FROM events)),
    ay AS (SELECT row_number() OVER (ORDER BY lat) - 1 AS j, lat FROM (SELECT DISTINCT {_doubles(f'{LAT0} + {STEP} * (user_id % {NLAT})')} AS lat FROM events))"""


def parcel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of parcels whose rings are boxes: each shell, hole or second part by its corners' least and largest shares."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", *[F.expr(_doubles(e)).alias(c) for c, e in _AT.items()])
    sides = lambda corners: [f(v) for f in (min, max) for v in zip(*corners, strict=True)]

    def ring(corners: tuple) -> Column:
        w, south, e, n = sides(corners)
        return F.array(*[F.struct((F.col("x0") + F.lit(x) * F.col("dx")).alias("x"), (F.col("y0") + F.lit(y) * F.col("dy")).alias("y")) for x, y in ((w, south), (e, south), (e, n), (w, n), (w, south))])

    first = F.when(F.expr(_RINGS[1][3]), F.array(ring(_SHELL), ring(_HOLE))).otherwise(F.array(ring(_SHELL)))
    parts = F.when(F.expr(_RINGS[2][3]), F.array(first, F.array(ring(_SECOND)))).otherwise(F.array(first))
    return M.edges_from_parts(s.select(F.concat(F.lit("s"), "s_suppkey").alias("place_id"), parts.alias("parts")))


_SIDES = ", ".join(f"({1 - 2 * ring}, {part}, {ring}, {', '.join(f'{f(v)}::DOUBLE' for f in (min, max) for v in zip(*corners, strict=True))})" for part, ring, corners, _ in _RINGS)
#: Cells inside or beside one inside (or, of places with none, those that a part touches), by the share that boxes less holes cover.
BOX_PARCELS = f"""parcel AS (SELECT s_suppkey, 's' || s_suppkey AS place_id, {', '.join(f'{_doubles(e)} AS {c}' for c, e in _AT.items())} FROM supplier),
    side(sign, part, ring, wx, sy, ex, ny) AS (VALUES {_SIDES}),
    pb AS (SELECT place_id, part, sign, x0 + wx * dx AS w, y0 + sy * dy AS s, x0 + ex * dx AS e, y0 + ny * dy AS n FROM parcel, side
           WHERE ring = 0 AND part = 0 OR ring = 1 AND s_suppkey % 3 = 0 OR part = 1 AND s_suppkey % 5 = 0),
    {SLAB_AXES},
    ex AS (SELECT i, lon, lon - coalesce((lon - lag(lon) OVER o) / 2, (lead(lon) OVER o - lon) / 2, 0.5::DOUBLE) AS x_lo, lon + coalesce((lead(lon) OVER o - lon) / 2, (lon - lag(lon) OVER o) / 2, 0.5::DOUBLE) AS x_hi FROM ax WINDOW o AS (ORDER BY lon)),
    ey AS (SELECT j, lat, lat - coalesce((lat - lag(lat) OVER o) / 2, (lead(lat) OVER o - lat) / 2, 0.5::DOUBLE) AS y_lo, lat + coalesce((lead(lat) OVER o - lat) / 2, (lat - lag(lat) OVER o) / 2, 0.5::DOUBLE) AS y_hi FROM ay WINDOW o AS (ORDER BY lat)),
    ins AS (SELECT DISTINCT place_id, i, j FROM (SELECT place_id, part, i, j FROM pb, ax, ay WHERE lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY ALL HAVING sum(sign) = 1)),
    want AS (SELECT DISTINCT place_id, i + a AS i, j + b AS j FROM ins, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)
             UNION SELECT place_id, i, j FROM pb, ex, ey WHERE sign = 1 AND x_hi >= w AND x_lo <= e AND y_hi >= s AND y_lo <= n AND place_id NOT IN (SELECT place_id FROM ins)),
    mask AS (SELECT place_id, lat AS latitude, lon AS longitude, least(1.0::DOUBLE, sum(sign * greatest(0.0::DOUBLE, least(x_hi, e) - greatest(x_lo, w)) / (x_hi - x_lo)
                 * greatest(0.0::DOUBLE, sin(radians(least(y_hi, n))) - sin(radians(greatest(y_lo, s)))) / (sin(radians(y_hi)) - sin(radians(y_lo))))) AS weight
             FROM want JOIN ex USING (i) JOIN ey USING (j) JOIN pb USING (place_id) GROUP BY ALL HAVING weight > 1e-9)"""


def box_mask(spark: SparkSession) -> DataFrame:
    return M.held_mask(spark, f"box|{BOX}|{LON0},{LAT0},{STEP},{NLON},{NLAT}|weights", lambda: M.grid_mask(edges(spark, "box"), *axes(spark)).drop("place_id"))


def places_mask(spark: SparkSession) -> DataFrame:
    return M.held_mask(spark, f"{PLACES}|{LON0},{LAT0},{STEP},{NLON},{NLAT}|centres", lambda: M.grid_mask(edges(spark, *PLACES), *axes(spark), weights=False))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as casts at suppliers' stations, in long format; the ship time is the cast's."""
    rows = read(spark, sf_dir, "lineitem")
    lat = F.lit(30.0) + F.lit(0.01) * (F.col("l_suppkey") % 50)
    lon = F.lit(-120.0) - F.lit(0.01) * (F.col("l_suppkey") % 37)
    value = F.when(F.col("l_orderkey") % 13 != 0, F.col("l_extendedprice"))
    return rows.select(F.col("l_shipdate").alias("time"), lat.alias("latitude"), lon.alias("longitude"), F.col("l_returnflag").alias("measurement_type"), value.alias("measurement_value"))


def station_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stats import small_side, stations

    return small_side(stations(points(spark, sf_dir)).where((F.col("latitude") > 30.045) & (F.col("longitude") < -120.055)).withColumn("weight", F.lit(1.0)))


POINTS = """pts AS (
    SELECT l_shipdate AS time, 30.0::DOUBLE + 0.01::DOUBLE * (l_suppkey % 50) AS latitude, -120.0::DOUBLE - 0.01::DOUBLE * (l_suppkey % 37) AS longitude, l_returnflag AS measurement_type,
           CASE WHEN l_orderkey % 13 <> 0 THEN l_extendedprice END AS value FROM lineitem),
    mask AS (SELECT DISTINCT latitude, longitude FROM pts WHERE latitude > 30.045 AND longitude < -120.055),
    joined AS (SELECT s.*, m.latitude AS mlat, m.longitude AS mlon FROM pts s JOIN mask m
               ON round(s.latitude, 5) = round(m.latitude, 5) AND round(s.longitude, 5) = round(m.longitude, 5) WHERE measurement_type = 'N' AND value IS NOT NULL)"""


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series: the mean order price."""
    return read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg(F.col("o_totalprice") * UNEVEN).alias("mean"), F.count("*").alias("n"))


DAILY = f"raw AS (SELECT o_orderdate::DATE AS date, avg(o_totalprice * {UNEVEN}::DOUBLE) AS mean, count(*) AS n FROM orders GROUP BY 1)"


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels of two places on an 8 x 8 lattice; the mean price is the value."""
    from ..functions.columns import band_of

    rows = read(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    return rows.groupBy(
        F.concat(F.lit("p"), F.col("l_linenumber") % 2).alias("place_id"), F.year(day).cast("long").alias("year"), band_of(day).alias("band"), (F.col("l_suppkey") % 8).alias("row"), (F.col("l_partkey") % 8).alias("col")
    ).agg(F.avg(F.when(F.col("l_orderkey") % 19 != 0, F.col("l_extendedprice") / 1000 * UNEVEN)).alias("value"))


CUBE = f"""cube AS (
    SELECT 'p' || (l_linenumber % 2) AS place_id, year(l_shipdate) AS year, dayofyear(make_date(2000, month(l_shipdate), day(l_shipdate))) AS band, l_suppkey % 8 AS row, l_partkey % 8 AS col,
           avg(CASE WHEN l_orderkey % 19 <> 0 THEN l_extendedprice / 1000 * {UNEVEN}::DOUBLE END) AS value FROM lineitem GROUP BY ALL)"""
CLIM = "clim AS (SELECT place_id, band, row, col, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM cube WHERE year BETWEEN 1995 AND 1998 GROUP BY ALL)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as catalog items."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("i"), k).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("place_id"), F.concat(F.lit("d"), k % 3).alias("collection"), F.concat(F.lit("v"), k % 5).alias("variable"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 400).cast("int")).alias("start"), F.date_add(F.lit("2021-06-01").cast("date"), (k % 300).cast("int")).alias("end"), k.alias("k"),
    )


ITEMS = """items AS (SELECT 'i' || c_custkey AS id, 'n' || c_nationkey AS place_id, 'd' || (c_custkey % 3) AS collection, 'v' || (c_custkey % 5) AS variable,
    DATE '2020-01-01' + (c_custkey % 400)::INT AS start, DATE '2021-06-01' + (c_custkey % 300)::INT AS "end", c_custkey AS k FROM customer)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series cut in spans of 40 days that overlap by ten, with rows outside their spans; later spans differ in the last bits."""
    d = daily_orders(spark, sf_dir)
    n = F.datediff("date", F.lit("1995-01-01").cast("date"))
    rows = d.withColumn("c", F.explode(F.array(F.expr("int(datediff(date, DATE'1995-01-01') / 30)"), F.expr("int(datediff(date, DATE'1995-01-01') / 30) - 1"))))
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("c") * 30)
    return rows.where((F.col("c") >= 0) & n.isNotNull()).select("date", "n", (F.col("mean") + F.col("c") * 1e-3).alias("mean"), start.alias("span_start"), F.date_add(start, 39).alias("span_end"))


CHUNKS = f"""{DAILY}, chunk AS (
    SELECT date, n, mean + c * 1e-3 AS mean, DATE '1995-01-01' + (c * 30)::INT AS span_start, DATE '1995-01-01' + (c * 30 + 39)::INT AS span_end
    FROM (SELECT *, unnest([date_diff('day', DATE '1995-01-01', date) // 30, date_diff('day', DATE '1995-01-01', date) // 30 - 1]) AS c FROM raw) WHERE c >= 0)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of three collections; ids repeat between collections."""
    s, c, n = (read(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    row = lambda df, key, name, area, coll, rank: df.select(F.concat(F.lit("p"), F.col(key)).alias("place_id"), F.col(name).alias("name"), F.lit(coll).alias("collection"), F.lit(rank).cast("long").alias("rank"), F.col(area).cast("double").alias("area_km2"))
    return row(s, "s_suppkey", "s_name", "s_acctbal", "leases", 2).unionByName(row(c, "c_custkey", "c_name", "c_acctbal", "cables", 3)).unionByName(row(n, "n_nationkey", "n_name", "n_nationkey", "sanctuaries", 1))


INDEX = """idx AS (
    SELECT 'p' || s_suppkey AS place_id, s_name AS name, 'leases' AS collection, 2::BIGINT AS rank, s_acctbal::DOUBLE AS area_km2 FROM supplier
    UNION ALL SELECT 'p' || c_custkey, c_name, 'cables', 3::BIGINT, c_acctbal::DOUBLE FROM customer
    UNION ALL SELECT 'p' || n_nationkey, n_name, 'sanctuaries', 1::BIGINT, n_nationkey::DOUBLE FROM nation)"""
