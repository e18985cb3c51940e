"""Named queries of the engine, bound to the carrier tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import geometry as G
from ..functions.clean import cleaned
from ..functions.wkb import parts_wkb, wkb_box, wkb_edges
from ..operators import catalog as K
from ..operators import choices as N
from ..operators import incremental as I
from ..operators import mask as M
from ..operators import series as S
from ..operators import stats as A
from ..sources import places as P
from ..sources import readers as R
from ..sources import writers as W
from ..sources.gridded import read_gridded
from ..sources.readers import info_extent
from ..streaming.assemble import read_chunks, write_assembled
from ..tables import fresh_path
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def held(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return held


def _stats(v: str) -> str:
    return (
        f"count({v}) AS n, round(avg({v}), 6) AS mean, round(sum({v} * weight) / sum(weight), 6) AS mean_wt, round(stddev_samp({v}), 6) AS sd, round(min({v}), 6) AS min, round(max({v}), 6) AS max, "
        f"round(quantile_cont({v}, 0.1), 6) AS p10, round(quantile_cont({v}, 0.9), 6) AS p90, round(sum(weight), 6) AS weight_sum"
    )


_GRID = f"WITH {B.SLAB}, {B.AXES}, {B.BOX_MASK}, {B.JOINED}"


# statistics inside a mask
@query(f"{_GRID} SELECT time::DATE AS date, {_stats('value')} FROM joined WHERE value IS NOT NULL GROUP BY 1")
def stats_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(A.stats_daily(B.slab(spark, sf_dir), B.box_mask(spark), C.value_expr("value")))


@query(f"{_GRID} SELECT time::DATE AS date, {_stats('value')} FROM joined WHERE value IS NOT NULL GROUP BY 1")
def stats_daily_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by ranks in a global order, for days of any number of cells."""
    return B.rounded(A.stats_daily(B.slab(spark, sf_dir), B.box_mask(spark), C.value_expr("value"), bounded=True))


@query(f"{_GRID} SELECT time::DATE AS date, {_stats('(value - 273.15::DOUBLE)')} FROM joined WHERE value IS NOT NULL GROUP BY 1")
def stats_daily_kelvin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(A.stats_daily(B.slab(spark, sf_dir), B.box_mask(spark), C.value_expr("value", "degree_Kelvin")))


@query(
    f"WITH {B.SLAB}, {B.AXES}, {B.EDGES}, {B.INSIDE} SELECT place_id, time::DATE AS date, {_stats('value').replace('weight', '1.0::DOUBLE', 2).replace('sum(weight)', 'count(*)::DOUBLE')} "
    "FROM slab s JOIN inside ON round(s.latitude::DOUBLE, 3) = round(lat, 3) AND round(s.longitude::DOUBLE, 3) = round(lon, 3) WHERE value IS NOT NULL GROUP BY ALL"
)
def stats_daily_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places in one pass over the slab."""
    return B.rounded(A.stats_daily(B.slab(spark, sf_dir), B.places_mask(spark), C.value_expr("value")))


@query(f"""{_GRID}, cells AS (SELECT time::DATE AS date, length(event_type)::BIGINT AS class, weight FROM joined),
    t AS (SELECT date, count(*) AS nt, sum(weight) AS wt FROM cells GROUP BY 1)
    SELECT date, class, count(*) AS n, round(sum(weight), 6) AS weight, round(sum(weight) / any_value(wt), 6) AS fraction, round(100.0::DOUBLE * count(*) / any_value(nt), 6) AS percent_cells
    FROM cells JOIN t USING (date) GROUP BY date, class""")
def stats_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(A.stats_categorical(B.slab(spark, sf_dir), B.box_mask(spark), F.length("event_type") + 0.25))


@query(f"""WITH {B.POINTS} SELECT date_trunc('month', time)::DATE AS date, count(value) AS n, count(DISTINCT (time, longitude, latitude)) AS n_casts, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
    round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM joined GROUP BY 1""")
def stats_monthly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = C.long_format(B.points(spark, sf_dir), "N")
    return B.rounded(A.stats_points(pts, B.station_mask(spark, sf_dir), F.col("value")))


@query(f"WITH {B.POINTS} SELECT round(mlat, 6) AS latitude, round(mlon, 6) AS longitude, 1.0::DOUBLE AS weight, round(avg(value), 6) AS value, count(value) AS n, max(time)::DATE AS date FROM joined GROUP BY mlat, mlon")
def points_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = C.long_format(B.points(spark, sf_dir), "N")
    return B.rounded(A.station_means(pts, B.station_mask(spark, sf_dir), F.col("value")))


@query(f"""{_GRID.replace("ts AS time", "date_trunc('day', ts) AS time")} SELECT time::DATE AS date, round(mlat, 6) AS latitude, round(mlon, 6) AS longitude, round(weight, 6) AS weight, round(value, 6) AS value
    FROM joined WHERE time = (SELECT max(time) FROM joined)""")
def last_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = B.slab(spark, sf_dir).withColumn("time", F.date_trunc("day", "time"))
    return B.rounded(A.last_step(days, B.box_mask(spark), C.value_expr("value")))


@query(f"WITH {B.SLAB} SELECT DISTINCT round(longitude::DOUBLE, 4) AS longitude, round(latitude::DOUBLE, 4) AS latitude FROM slab")
def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(A.stations(B.slab(spark, sf_dir)).select(*[F.col(c).cast("double") for c in ("longitude", "latitude")]), 4)


@query(f"WITH {B.SLAB} SELECT event_type, count(*) AS n, count(value) AS valid FROM (SELECT DISTINCT * FROM slab) GROUP BY 1")
def slab_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lobes whose rows overlap: repeats count once."""
    slab = B.slab(spark, sf_dir)
    return A.without_repeats(slab, slab.where("latitude > 20.3")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("valid"))


# masks
_CELLS = f"WITH {B.SLAB_AXES}, {B.PARCELS}, {B.INSIDE}"


@query(f"{_CELLS} SELECT place_id, round(lat, 6) AS latitude, round(lon, 6) AS longitude, 1.0::DOUBLE AS weight FROM inside")
def grid_mask_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parcels on the slab's own axes."""
    return B.rounded(M.grid_mask(B.parcel_edges(spark, sf_dir), *B.slab_axes(spark, sf_dir), weights=False))


@query(f"{_CELLS} SELECT place_id, i, j, round(lon, 6) AS lon, round(lat, 6) AS lat FROM inside")
def grid_mask_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = B.slab_axes(spark, sf_dir)
    return B.rounded(M.inside_parity(B.parcel_edges(spark, sf_dir), M.axis_edges(lon), M.axis_edges(lat)).select("place_id", F.col("i").cast("long"), F.col("j").cast("long"), "lon", "lat"))


@query(f"WITH {B.SLAB_AXES}, {B.PARCELS}, box AS (SELECT place_id, part, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM pe WHERE ring = 0 GROUP BY ALL) SELECT DISTINCT place_id, i, j, round(lon, 6) AS lon, round(lat, 6) AS lat FROM box, ax, ay WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")
def mask_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = B.slab_axes(spark, sf_dir)
    return B.rounded(M.candidates(B.parcel_edges(spark, sf_dir), M.axis_edges(lon), M.axis_edges(lat)).select("place_id", F.col("i").cast("long"), F.col("j").cast("long"), "lon", "lat"))


@query(f"WITH {B.PARCELS} SELECT place_id, part, ring, k, round(px, 6) AS ax, round(py, 6) AS ay, round(qx, 6) AS bx, round(qy, 6) AS by FROM pe")
def parcel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to edges, through well-known binary."""
    places = B.parcels(spark, sf_dir).select("place_id", parts_wkb("parts").alias("geometry"))
    return B.rounded(wkb_edges(places).where("reason is null").drop("reason"))


@query(f"WITH {B.BOX_PARCELS} SELECT place_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(weight, 6) AS weight FROM mask")
def grid_mask_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(M.grid_mask(B.parcel_boxes(spark, sf_dir), *B.slab_axes(spark, sf_dir)))


@query(f"WITH {B.BOX_PARCELS} SELECT count(*) AS cells, round(sum(weight), 6) AS total_weight, count(*) FILTER (weight < 0.999) AS partial FROM mask")
def mask_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(A.mask_summary(M.grid_mask(B.parcel_boxes(spark, sf_dir), *B.slab_axes(spark, sf_dir))))


@query(f"""WITH {B.EDGES}, pos AS (SELECT DISTINCT {B.LON0} + 0.001::DOUBLE * (c_custkey % 503) AS lon, {B.LAT0} + 0.001::DOUBLE * (c_custkey % 701) AS lat FROM customer),
    hit AS (SELECT place_id, part, lon, lat FROM pos, edges WHERE (py > lat) <> (qy > lat) AND lon < px + (lat - py) * (qx - px) / (qy - py) GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT DISTINCT place_id, round(lon, 6) AS lon, round(lat, 6) AS lat, 1.0::DOUBLE AS weight FROM hit""")
def point_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pos = B.read(spark, sf_dir, "customer").select((F.lit(B.LON0) + F.lit(0.001) * (k % 503)).alias("lon"), (F.lit(B.LAT0) + F.lit(0.001) * (k % 701)).alias("lat"))
    return B.rounded(M.point_mask(B.edges(spark, *B.PLACES), pos))


_LATTICE = "v AS (SELECT DISTINCT (s_suppkey * s_suppkey)::DOUBLE / 8 AS centre FROM supplier)"


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "supplier").select(((F.col("s_suppkey") * F.col("s_suppkey")).cast("double") / 8).alias("centre")).distinct()


@query(f"""WITH {_LATTICE}, g AS (SELECT centre, lag(centre) OVER w AS p, lead(centre) OVER w AS n, row_number() OVER w - 1 AS i FROM v WINDOW w AS (ORDER BY centre))
    SELECT i, centre, centre - coalesce((centre - p) / 2, (n - centre) / 2, 0.5::DOUBLE) AS lo, centre + coalesce((n - centre) / 2, (centre - p) / 2, 0.5::DOUBLE) AS hi FROM g""")
def axis_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.axis_edges(_centres(spark, sf_dir)).withColumn("i", F.col("i").cast("long"))


@query(f"WITH {_LATTICE} SELECT round(median(gap), 6) AS spacing FROM (SELECT centre - lag(centre) OVER (ORDER BY centre) AS gap FROM v)")
def axis_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(M.axis_spacing(_centres(spark, sf_dir)))


_BOXES = """b AS (SELECT 'n' || s_nationkey AS place_id, s_suppkey AS part, ((s_suppkey * 37) % 340 - 175)::DOUBLE AS x0, ((s_suppkey * 37) % 340 - 175 + s_suppkey % 5)::DOUBLE AS x1,
    (s_suppkey % 60)::DOUBLE AS y0, (s_suppkey % 60 + 3)::DOUBLE AS y1 FROM supplier WHERE s_nationkey % 3 > 0 OR (s_suppkey * 37) % 340 < 170)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    west = (k * 37) % 340 - 175
    rows = B.read(spark, sf_dir, "supplier").where((F.col("s_nationkey") % 3 > 0) | ((k * 37) % 340 < 170))
    d = lambda c, name: c.cast("double").alias(name)
    return rows.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("place_id"), k.alias("part"), d(west, "x0"), d(west + k % 5, "x1"), d(k % 60, "y0"), d(k % 60 + 3, "y1"))


@query(f"""WITH {_BOXES}, w AS (SELECT *, max(x1) OVER p - min(x0) OVER p > 180 AS wide FROM b WINDOW p AS (PARTITION BY place_id))
    SELECT place_id, place_id || CASE WHEN NOT wide THEN '' WHEN (x0 + x1) / 2 < 0 THEN ':W' ELSE ':E' END AS lobe_id, min(x0) AS west, min(y0) AS south, max(x1) AS east, max(y1) AS north, count(*) AS n_parts FROM w GROUP BY ALL""")
def lobes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lobes(_boxes(spark, sf_dir))


@query(f"""WITH {_BOXES}, s AS (SELECT place_id, x0 AS a, x1 AS b FROM b), m AS (SELECT *, max(b) OVER (PARTITION BY place_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT place_id, a - reach AS gap, a, reach FROM m WHERE a > reach QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY a - reach DESC, a) = 1),
    t AS (SELECT place_id, min(x0) AS f, max(x1) AS l, min(y0) AS south, max(y1) AS north FROM b GROUP BY 1)
    SELECT place_id, CASE WHEN gap > f + 360 - l THEN a ELSE f END AS west, south, CASE WHEN gap > f + 360 - l THEN reach ELSE l END AS east, north FROM t LEFT JOIN i USING (place_id)""")
def union_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.union_bbox(_boxes(spark, sf_dir).withColumnsRenamed({"x0": "west", "y0": "south", "x1": "east", "y1": "north"}))


@query("""WITH v AS (SELECT c_custkey AS k, (c_custkey % 1081 - 540)::DOUBLE / 1.5 AS lon FROM customer)
    SELECT k, round(CASE WHEN lon - 360 * floor(lon / 360) > 180 THEN lon - 360 * floor(lon / 360) - 360 ELSE lon - 360 * floor(lon / 360) END, 6) AS about_0, round(lon - 360 * floor(lon / 360), 6) AS about_180,
           round(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END, 6) AS in_dataset FROM v""")
def lon_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = (F.col("c_custkey") % 1081 - 540).cast("double") / 1.5
    return B.rounded(B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), C.normal_longitude(lon).alias("about_0"), C.normal_longitude(lon, 180).alias("about_180"), C.dataset_longitude(lon, 359.9).alias("in_dataset")))


# day-of-year series and cubes
def _series_sql(smooth: int) -> str:
    value = "mean" if smooth < 2 else f"avg(mean) OVER (PARTITION BY year(date) ORDER BY date ROWS BETWEEN {smooth // 2} PRECEDING AND {(smooth - 1) // 2} FOLLOWING)"
    return f"""WITH {B.DAILY}, s AS (SELECT date, year(date) AS year, dayofyear(make_date(2000, month(date), day(date))) AS band, {value} AS value FROM raw),
        c AS (SELECT band, avg(value) AS clim FROM s WHERE year BETWEEN 1995 AND 1998 GROUP BY 1)
        SELECT year, band, date, round(value, 6) AS value, round(clim, 6) AS clim, round(value - clim, 6) AS anom FROM s LEFT JOIN c USING (band)"""


@query(_series_sql(0))
def series_doy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.series_by_day(B.daily_orders(spark, sf_dir), (1995, 1998)))


@query(_series_sql(7))
def series_doy_smooth7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.series_by_day(B.daily_orders(spark, sf_dir), (1995, 1998), smooth=7))


@query(_series_sql(4))
def series_doy_smooth4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.series_by_day(B.daily_orders(spark, sf_dir), (1995, 1998), smooth=4))


@query(f"""WITH {B.DAILY}, s AS (SELECT year(date) AS year, month(date) AS month, mean FROM raw)
    SELECT DISTINCT year, month, round(avg(CASE WHEN year BETWEEN 1995 AND 1997 THEN mean END) OVER (PARTITION BY month), 6) AS then_mean FROM s""")
def filtered_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered average over a window: the condition goes inside the average."""
    rows = B.daily_orders(spark, sf_dir).select(F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month"), "mean")
    then = F.avg(F.when(F.col("year").between(1995, 1997), F.col("mean"))).over(Window.partitionBy("month"))
    return B.rounded(rows.withColumn("then_mean", then).select("year", "month", "then_mean").distinct())


@query(f"WITH {B.CUBE}, {B.CLIM} SELECT place_id, band, row, col, round(mean, 6) AS mean, round(sd, 6) AS sd, n FROM clim")
def climatology_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.climatology(B.cube(spark, sf_dir), (1995, 1998)))


@query(f"""WITH {B.CUBE}, p AS (SELECT place_id, ((band - 1 + k) % 366 + 366) % 366 + 1 AS band, row, col, value FROM cube, (SELECT unnest(range(-2, 3)) AS k) WHERE year BETWEEN 1995 AND 1998)
    SELECT place_id, band, row, col, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(value) AS n FROM p GROUP BY ALL""")
def climatology_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.climatology(B.cube(spark, sf_dir), (1995, 1998), pool=2))


_WEIGHTS = "w AS (SELECT place_id, r AS row, c AS col, (1 + r + c)::DOUBLE / 16 AS weight FROM (VALUES ('p0'), ('p1')) p(place_id), range(8) a(r), range(8) b(c) WHERE r + c > 2)"


def _weights(spark: SparkSession) -> DataFrame:
    cells = spark.range(128).select(F.concat(F.lit("p"), F.expr("id div 64")).alias("place_id"), F.expr("id div 8 % 8").alias("row"), F.expr("id % 8").alias("col"))
    return cells.where("row + col > 2").withColumn("weight", (1 + F.col("row") + F.col("col")).cast("double") / 16)


@query(f"""WITH {B.CUBE}, {_WEIGHTS} SELECT place_id, year, band, round(sum(value * weight) / sum(weight), 6) AS mean, round(avg(value), 6) AS mean_unwt, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max,
    count(value)::INT AS n_cells, round(sum(weight), 6) AS weight_sum FROM cube JOIN w USING (place_id, row, col) WHERE value IS NOT NULL GROUP BY ALL""")
def zonal_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.zonal_daily(B.cube(spark, sf_dir), _weights(spark)))


@query(f"WITH {B.CUBE}, {B.CLIM} SELECT place_id, year, band, row, col, round(value - mean, 6) AS anom FROM cube JOIN clim USING (place_id, band, row, col)")
def anomaly_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = B.cube(spark, sf_dir)
    return B.rounded(S.anomaly(cube, S.climatology(cube, (1995, 1998))))


@query(f"""WITH {B.CUBE}, {B.CLIM}, a AS (SELECT place_id, year, row, value - mean AS anom, 0.125::DOUBLE * 111.32 * cos(radians(25.5 - (row + 0.5) * 0.125)) * 0.125 * 110.57 AS km2 FROM cube JOIN clim USING (place_id, band, row, col))
    SELECT place_id, year, count(*) FILTER (anom > 2.5) AS n, count(*) AS valid, round(sum(CASE WHEN anom > 2.5 THEN km2 ELSE 0 END), 4) AS km2, round(sum(km2), 4) AS valid_km2 FROM a WHERE anom IS NOT NULL GROUP BY ALL""")
def exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = B.cube(spark, sf_dir)
    anomalies = S.anomaly(cube, S.climatology(cube, (1995, 1998)))
    return B.rounded(S.exceedance(anomalies, 2.5, (-81.0, 24.5, -80.0, 25.5), 8, 8, ("place_id", "year")), 4)


@query(f"""WITH {B.CUBE} SELECT place_id, year, band, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(100.0::DOUBLE * count(value) / count(*), 6) AS valid_percent FROM cube GROUP BY ALL""")
def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.band_statistics(B.cube(spark, sf_dir)))


@query(f"""WITH {B.CUBE}, v AS (SELECT place_id, year, band, count(value) AS n FROM cube GROUP BY ALL)
    SELECT place_id, max(year) AS year, 59::BIGINT AS band FROM v WHERE n > 0 AND year <= 2000 AND band = CASE WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 60 ELSE 59 END AND NOT ((year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0)
    GROUP BY 1 HAVING max(year) > (SELECT coalesce(max(year), 0) FROM v x WHERE n > 0 AND band = 60 AND year <= 2000 AND x.place_id = v.place_id)
    UNION ALL SELECT place_id, max(year), 60::BIGINT FROM v WHERE n > 0 AND year <= 2000 AND band = 60 GROUP BY 1 HAVING max(year) > (SELECT coalesce(max(year), 0) FROM v x WHERE n > 0 AND band = 59 AND year <= 2000 AND x.year % 4 <> 0 AND x.place_id = v.place_id)""")
def now_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = B.cube(spark, sf_dir).groupBy("place_id", "year", "band").agg(F.count("value").alias("n"))
    return S.now_choice(valid, 2000, 60).select("place_id", "year", F.col("band").cast("long"))


@query(f"""WITH {B.CUBE}, t AS (SELECT place_id, row, col, avg(value) AS v FROM cube WHERE band = 100 AND year BETWEEN 1995 AND 1998 GROUP BY ALL) SELECT place_id, row, col, round(v, 6) AS mean FROM t""")
def custom_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.mean_of_years(B.cube(spark, sf_dir), 100, (1995, 1998)).drop("n"))


# incremental series
_WINDOWS = "win AS (SELECT 'u' || n_nationkey AS unit, DATE '2026-01-01' + (n_nationkey % 7)::INT AS ws, DATE '2026-12-31' - (n_nationkey % 11)::INT AS we FROM nation)"
_DONE = """done AS (SELECT 'u' || s_nationkey AS unit, DATE '2026-01-01' + ((s_suppkey * 17) % 330)::INT AS s, DATE '2026-01-01' + ((s_suppkey * 17) % 330 + s_suppkey % 29)::INT AS e FROM supplier)"""


@query(f"""WITH {_WINDOWS}, {_DONE}, days AS (SELECT unit, unnest(generate_series(ws, we, INTERVAL 1 DAY))::DATE AS d, ws, we FROM win),
    open AS (SELECT unit, d FROM days x WHERE NOT EXISTS (SELECT 1 FROM done y WHERE y.unit = x.unit AND y.s >= x.ws AND y.e <= x.we AND x.d BETWEEN y.s AND y.e)),
    g AS (SELECT unit, d, d - row_number() OVER (PARTITION BY unit ORDER BY d)::INT AS k FROM open) SELECT unit, min(d) AS start, max(d) AS "end" FROM g GROUP BY unit, k""")
def chunk_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda base, n: F.date_add(F.lit(base).cast("date"), n.cast("int"))
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    windows = B.read(spark, sf_dir, "nation").select(F.concat(F.lit("u"), n).alias("unit"), day("2026-01-01", n % 7).alias("start"), day("2026-12-31", -(n % 11)).alias("end"))
    at = (k * 17) % 330
    done = B.read(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), F.col("s_nationkey")).alias("unit"), day("2026-01-01", at).alias("start"), day("2026-01-01", at + k % 29).alias("end"))
    return I.gaps(done, windows)


@query(f"""WITH {_WINDOWS}, f AS (SELECT 'u' || s_nationkey AS unit, 'f' || s_suppkey AS file, CASE WHEN s_suppkey % 13 > 0 THEN DATE '2026-01-01' + ((s_suppkey * 17) % 350)::INT END AS s,
        CASE WHEN s_suppkey % 13 > 0 THEN DATE '2026-01-01' + ((s_suppkey * 17) % 350 + s_suppkey % 29)::INT END AS e FROM supplier),
    i AS (SELECT f.*, ws, we, coalesce(s >= ws AND e <= we, false) AS fits FROM f LEFT JOIN win USING (unit)), t AS (SELECT *, max(e) OVER (PARTITION BY unit, fits) AS tip FROM i),
    a AS (SELECT *, CASE WHEN NOT fits THEN 'remove' WHEN e = tip AND e < we AND e - s + 1 < 25 AND count(*) FILTER (e = tip) OVER (PARTITION BY unit, fits) = 1 THEN 'replace' ELSE 'keep' END AS action FROM t),
    days AS (SELECT unit, unnest(generate_series(ws, we, INTERVAL 1 DAY))::DATE AS d FROM win), open AS (SELECT unit, d FROM days x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.unit = x.unit AND action = 'keep' AND x.d BETWEEN y.s AND y.e)),
    g AS (SELECT unit, d, d - row_number() OVER (PARTITION BY unit ORDER BY d)::INT AS k FROM open), h AS (SELECT unit, d, k, (row_number() OVER (PARTITION BY unit, k ORDER BY d) - 1) // 25 AS part FROM g)
    SELECT unit, file, s AS start, e AS "end", action FROM a UNION ALL SELECT unit, NULL, min(d), max(d), 'fetch' FROM h GROUP BY unit, k, part""")
def chunk_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many units against their windows: what stays, goes, is made anew and is fetched."""
    day = lambda base, n: F.date_add(F.lit(base).cast("date"), n.cast("int"))
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    windows = B.read(spark, sf_dir, "nation").select(F.concat(F.lit("u"), n).alias("unit"), day("2026-01-01", n % 7).alias("start"), day("2026-12-31", -(n % 11)).alias("end"))
    at = F.when(k % 13 > 0, (k * 17) % 350)
    files = B.read(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), F.col("s_nationkey")).alias("unit"), F.concat(F.lit("f"), k).alias("file"), day("2026-01-01", at).alias("start"), day("2026-01-01", at + k % 29).alias("end"))
    return I.chunk_work(files, windows, 25)


@query(f"WITH {_WINDOWS}, s AS (SELECT unit, unnest(generate_series(ws, we, INTERVAL 20 DAY))::DATE AS slice_start, we FROM win) SELECT unit, slice_start, least(we, slice_start + 19) AS slice_end FROM s")
def chunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    windows = B.read(spark, sf_dir, "nation").select(F.concat(F.lit("u"), n).alias("unit"), F.date_add(F.lit("2026-01-01").cast("date"), (n % 7).cast("int")).alias("start"), F.date_add(F.lit("2026-12-31").cast("date"), (-(n % 11)).cast("int")).alias("end"))
    return I.slice_table(windows, 20).select("unit", F.col("slice_start").cast("date").alias("slice_start"), "slice_end")


@query(f"""WITH {B.CHUNKS} SELECT date, n, round(mean, 6) AS mean, 'pid' AS place_id, 'ds' AS dataset_id, 'v' AS variable FROM chunk WHERE date BETWEEN span_start AND span_end
    QUALIFY row_number() OVER (PARTITION BY date ORDER BY span_start, span_end) = 1""")
def assemble_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(I.assemble(B.chunks(spark, sf_dir), {"place_id": "pid", "dataset_id": "ds", "variable": "v"}))


@query(f"""WITH {B.CHUNKS}, c AS (SELECT date, class, n + class AS n, span_start, span_end FROM chunk, (SELECT unnest([1, 2, 3])::BIGINT AS class))
    SELECT date, class, n, 'pid' AS place_id FROM c WHERE date BETWEEN span_start AND span_end QUALIFY row_number() OVER (PARTITION BY date, class ORDER BY span_start, span_end) = 1""")
def assemble_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.chunks(spark, sf_dir).withColumn("class", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)]))).select("date", "class", (F.col("n") + F.col("class")).alias("n"), "span_start", "span_end")
    return I.assemble(rows, {"place_id": "pid"}, ("date", "class"))


@query(f"WITH {B.DAILY} SELECT date, round(mean, 6) AS mean, n FROM raw WHERE date BETWEEN DATE '1996-02-10' AND DATE '1996-04-20'")
def coverage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a materialised series that covers it."""
    orders = B.read(spark, sf_dir, "orders").where(F.col("o_orderdate").between(F.lit("1996-02-10").cast("timestamp"), F.lit("1996-04-20 23:59:59.999999").cast("timestamp")))
    series = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg(F.col("o_totalprice") * B.UNEVEN).alias("mean"), F.count("*").alias("n"))
    return B.rounded(I.in_window(series, "1996-02-10", "1996-04-20"))


# catalog
@query(f"WITH {B.ITEMS} SELECT id, place_id FROM items WHERE k % 4 <> 0")
def manifest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.items(spark, sf_dir)
    return K.pending(items.unionByName(items), items.where("k % 4 = 0")).select("id", "place_id")


@query(f"WITH {B.ITEMS} SELECT id, 'fresh' AS state FROM items WHERE k % 3 = 0 UNION ALL SELECT id, 'earlier' FROM items WHERE k % 3 <> 0 AND k % 2 = 0 AND variable <> 'v4'")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.items(spark, sf_dir)
    fresh = items.where("k % 3 = 0").withColumn("state", F.lit("fresh"))
    earlier = items.where("k % 2 = 0").withColumn("state", F.lit("earlier"))
    return K.merge_items(fresh, earlier, F.col("variable") != "v4").select("id", "state")


@query(f"WITH {B.ITEMS} SELECT id FROM items WHERE id NOT IN (SELECT id FROM items WHERE k % 7 < 5)")
def manifest_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.items(spark, sf_dir)
    return K.unlisted(items, items.where("k % 7 < 5"), "id").select("id")


@query(f"WITH {B.ITEMS} SELECT id, place_id FROM items WHERE place_id IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def manifest_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = B.read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("place_id"))
    return K.listed(B.items(spark, sf_dir), covered).select("id", "place_id")


@query(f"""WITH {B.ITEMS} SELECT collection, min(start) AS start, max("end") AS "end", count(*) AS items, count(DISTINCT place_id) AS places, array_to_string(list_sort(list_distinct(list(variable))), ',') AS variables FROM items GROUP BY 1""")
def collection_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.roll_up(B.items(spark, sf_dir))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN 'expired' WHEN s_nationkey % 2 = 0 THEN 'active' ELSE 'unknown' END AS status, CASE WHEN s_suppkey % 6 = 0 THEN 'op' || s_suppkey ELSE 'none' END AS operator FROM supplier")
def status_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.read(spark, sf_dir, "supplier")
    key = F.concat(F.lit("OCS-"), F.col("s_suppkey")).alias("lease")
    rows = s.select(F.col("s_suppkey").alias("k"), key, F.when(F.col("s_nationkey") % 2 == 0, "active").otherwise("unknown").alias("status"), F.lit("none").alias("operator"))
    overlay = s.where("s_suppkey % 6 = 0").select(F.concat(F.lit(" OCS-"), F.col("s_suppkey"), F.lit(" ")).alias("lease"), F.lit("expired").alias("status"), F.concat(F.lit("op"), F.col("s_suppkey")).alias("operator"))
    return K.overlay_status(rows, overlay, "lease", ["status", "operator"]).select("k", "status", "operator")


@query(f"""WITH {B.INDEX}, w AS (SELECT 'p' || n_nationkey AS place_id, CASE n_nationkey % 3 WHEN 0 THEN 'cables' WHEN 1 THEN 'leases' END AS wanted FROM nation)
    SELECT place_id, wanted, collection, name, count(*) OVER (PARTITION BY place_id, wanted) > 1 AS ambiguous FROM w JOIN idx USING (place_id)
    QUALIFY row_number() OVER (PARTITION BY place_id, wanted ORDER BY coalesce(collection = wanted, false) DESC, rank, collection) = 1""")
def resolve_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    wanted = B.read(spark, sf_dir, "nation").select(F.concat(F.lit("p"), n).alias("place_id"), F.when(n % 3 == 0, "cables").when(n % 3 == 1, "leases").alias("collection"))
    return K.resolve_places(B.index(spark, sf_dir), wanted).select("place_id", "wanted", "collection", "name", "ambiguous")


@query(f"WITH {B.INDEX} SELECT collection, place_id, name, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY collection) - 50, 0) AS more FROM idx WINDOW w AS (PARTITION BY collection ORDER BY name, place_id) QUALIFY row_number() OVER w <= 50")
def picker_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.capped(B.index(spark, sf_dir), "collection", ["name", "place_id"], F.lit(50)).select("collection", "place_id", "name", "place", "more")


@query(f"""WITH {B.INDEX}, h AS (SELECT * FROM idx WHERE lower(name) LIKE '%r%'), s AS (SELECT *, greatest(10, least(50, 200 // (SELECT count(DISTINCT collection) FROM h))) AS share FROM h)
    SELECT collection, place_id, name, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY collection) - share, 0) AS more FROM s WINDOW w AS (PARTITION BY collection ORDER BY area_km2 DESC, name, place_id) QUALIFY row_number() OVER w <= share""")
def search_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = B.index(spark, sf_dir).where(F.lower("name").contains("r"))
    return K.search(hits, "collection", [F.desc("area_km2"), "name", "place_id"]).select("collection", "place_id", "name", "place", "more")


@query("""WITH r AS (SELECT p_partkey AS k, 'a' || (p_partkey % 97) AS id, CASE p_partkey % 3 WHEN 0 THEN 'x' ELSE 'y' END AS label FROM part), a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS nth FROM r),
    b AS (SELECT *, row_number() OVER (PARTITION BY id, label, nth > 1 ORDER BY k) AS again FROM a)
    SELECT k, CASE WHEN nth = 1 THEN id ELSE id || ':' || label || CASE WHEN again > 1 THEN '-' || again ELSE '' END END AS unique_id FROM b""")
def suffix_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = B.read(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("a"), k % 97).alias("id"), F.when(k % 3 == 0, "x").otherwise("y").alias("label"))
    return K.suffix_repeats(rows, "id", "label", ["k"]).select("k", "unique_id")


@query("""SELECT 'd' || n_nationkey AS dataset_id, strftime(to_timestamp(1000000000 + n_nationkey * 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS start, '2026-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS "end",
    CASE WHEN n_nationkey % 2 = 0 THEN 1.0::DOUBLE ELSE 8.0::DOUBLE END AS step_days, CASE WHEN n_nationkey % 2 = 0 THEN 'daily' ELSE '8-day' END AS step_label, (100 + n_nationkey)::BIGINT AS n_values FROM nation""")
def info_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents from attribute rows: ranges in seconds, or coverage attributes where a range has one end."""
    n = F.col("n_nationkey")
    base = B.read(spark, sf_dir, "nation").select(n, F.concat(F.lit("d"), n).alias("dataset_id"))
    row = lambda kind, var, attr, value: F.struct(F.lit(kind).alias("row_type"), F.lit(var).alias("variable"), F.lit(attr).alias("attribute"), value.alias("value"))
    step = F.when(n % 2 == 0, "1 day").otherwise("8 days 0h 0m 0s")
    rows = base.select("dataset_id", F.explode(F.array(
        row("attribute", "time", "actual_range", (F.lit(1000000000) + n * 86400).cast("string")), row("attribute", "NC_GLOBAL", "time_coverage_end", F.concat(F.lit("2026-01-"), F.lpad((n + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))),
        row("dimension", "time", "", F.concat(F.lit("nValues="), (n + 100).cast("string"), F.lit(", evenlySpaced=true, averageSpacing="), step)))).alias("r")).select("dataset_id", "r.*")
    return info_extent(rows)


@query("""SELECT 'h' || (user_id % 20) AS host, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, min(ts) AS first, max(ts) AS last, count(DISTINCT user_id) AS units FROM events GROUP BY 1""")
def outage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.read(spark, sf_dir, "events")
    return K.outages(e.select(F.concat(F.lit("h"), F.col("user_id") % 20).alias("host"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.col("user_id").alias("unit")))


@query("SELECT event_type AS status, count(*) AS units, sum(user_id)::BIGINT AS rows, sum(event_id)::BIGINT AS bytes FROM events GROUP BY 1")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.read(spark, sf_dir, "events")
    return K.run_totals(e.select(F.col("event_type").alias("status"), F.col("user_id").alias("rows"), F.col("event_id").alias("bytes")))


@query("SELECT o_orderkey AS k, dayofyear(make_date(2000, month(o_orderdate), day(o_orderdate))) AS band, (dayofyear(make_date(2000, month(o_orderdate), day(o_orderdate))) - 1 + 361) % 366 + 1 AS five_before FROM orders")
def leap_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = C.band_of(F.to_date("o_orderdate"))
    return B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), band.alias("band"), C.step_band(band, -5).alias("five_before"))


@query("SELECT name, count(*) AS n FROM (SELECT DISTINCT 'p' || (c_custkey % 9) AS name, c_custkey % 9 AS k FROM customer) GROUP BY 1")
def provider_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = B.read(spark, sf_dir, "customer").select(F.concat(F.lit("p"), k % 9).alias("name"), k.alias("ord"), F.lit("u").alias("url"), F.lit("host").alias("role"))
    return K.first_providers(rows).groupBy("name").agg(F.count("*").alias("n"))


# choices of targets, frames, boxes, lattices and names
@query("""WITH t AS (SELECT DISTINCT 'd' || (p_partkey % 7) AS dataset, 'v' || (p_partkey % 3) AS variable, p_partkey % 7 AS k FROM part), p AS (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN 'NMS:' ELSE 'GEO:' END || (c_custkey % 60) AS place_id FROM customer)
    SELECT dataset, variable, place_id, CASE WHEN k = 3 THEN '90' ELSE 'all' END AS days FROM t JOIN p ON k % 3 = 0 OR (k % 3 = 1 AND place_id LIKE 'NMS:%') WHERE dataset <> 'd6'
    UNION ALL SELECT dataset, variable, unnest(['NMS:4', 'own:' || k]), 'all' FROM t WHERE k % 3 = 2 AND dataset <> 'd6'""")
def target_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    rule = F.when(k % 3 == 0, "all").when(k % 3 == 1, "nms").otherwise("list")
    targets = B.read(spark, sf_dir, "part").select(
        F.concat(F.lit("d"), k).alias("dataset"), F.concat(F.lit("v"), F.col("p_partkey") % 3).alias("variable"), rule.alias("rule"),
        F.array(F.lit("NMS:4"), F.concat(F.lit("own:"), k)).alias("places"), F.when(k == 3, "90").alias("days")).distinct()
    c = F.col("c_custkey")
    places = B.read(spark, sf_dir, "customer").select(F.concat(F.when(c % 4 == 0, "NMS:").otherwise("GEO:"), c % 60).alias("place_id"))
    return N.select_targets(targets, places, datasets=tuple(f"d{i}" for i in range(6)))


@query("SELECT c_nationkey AS place_id, CASE WHEN max(x) - min(x) > 180 THEN 180 ELSE 0 END AS centre FROM (SELECT c_nationkey, CASE WHEN lon > 180 THEN lon - 360 WHEN lon <= -180 THEN lon + 360 ELSE lon END AS x FROM (SELECT c_nationkey, c_custkey % (20 + c_nationkey * 9) + 100.5::DOUBLE AS lon FROM customer)) GROUP BY 1")
def frame_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = F.col("c_custkey") % (20 + F.col("c_nationkey") * 9) + F.lit(100.5)
    return N.frame_choice(B.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("place_id"), lon.alias("longitude")))


_VERTICES = "v AS (SELECT c_nationkey AS place_id, (c_custkey % 60 + 150.25::DOUBLE) - CASE WHEN c_custkey % 60 > 29 THEN 360 ELSE 0 END AS lon, c_custkey % 17 + c_nationkey + 0.5::DOUBLE AS lat FROM customer WHERE c_nationkey % 5 <> 4)"


@query(f"""WITH {_VERTICES}, p AS (SELECT n_nationkey AS place_id, CASE WHEN n_nationkey % 2 = 0 THEN -180.0 ELSE 10.0 END::DOUBLE AS x0, -1.0::DOUBLE AS y0, CASE WHEN n_nationkey % 2 = 0 THEN 180.0 ELSE 20.0 END::DOUBLE AS x1, 1.0::DOUBLE AS y1 FROM nation),
    b AS (SELECT place_id, min((lon + 360) % 360) AS w, min(lat) AS s, max((lon + 360) % 360) AS e, max(lat) AS n FROM v JOIN p USING (place_id) WHERE x1 - x0 > 180 GROUP BY 1)
    SELECT place_id, coalesce(w, x0) AS west, coalesce(s, y0) AS south, coalesce(e, x1) AS east, coalesce(n, y1) AS north FROM p LEFT JOIN b USING (place_id)""")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    lon = (k % 60 + F.lit(150.25)) - F.when(k % 60 > 29, 360).otherwise(0)
    vertices = B.read(spark, sf_dir, "customer").where(n % 5 != 4).select(n.alias("place_id"), lon.alias("lon"), (k % 17 + n + F.lit(0.5)).alias("lat"))
    wide = F.col("n_nationkey") % 2 == 0
    x0, x1 = F.when(wide, F.lit(-180.0)).otherwise(F.lit(10.0)), F.when(wide, F.lit(180.0)).otherwise(F.lit(20.0))
    places = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place_id"), x0.alias("x0"), F.lit(-1.0).alias("y0"), x1.alias("x1"), F.lit(1.0).alias("y1"))
    return N.map_bounds(places, vertices)


@query("SELECT DISTINCT l_quantity AS l_quantity FROM lineitem WHERE l_quantity BETWEEN 7 AND 31")
def axis_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.axis_table(B.read(spark, sf_dir, "lineitem"), "l_quantity", 7.0, 31.0, descending=True)


@query("""WITH t AS (SELECT c_custkey AS k, c_custkey % 400 * 0.05::DOUBLE + CASE WHEN c_custkey % 9 = 0 THEN 0.02 ELSE 0.00003 END::DOUBLE AS x0, 80.0::DOUBLE - c_custkey % 31 * 0.05::DOUBLE - 0.00002::DOUBLE AS y0, 0.04999998::DOUBLE AS dx, CASE WHEN c_custkey % 11 = 0 THEN -0.051 ELSE -0.05 END::DOUBLE AS dy FROM customer),
    s AS (SELECT *, round_even(x0 / 0.05::DOUBLE, 0) * 0.05::DOUBLE AS x, round_even(y0 / 0.05::DOUBLE, 0) * 0.05::DOUBLE AS y FROM t)
    SELECT k, round(x, 6) AS x0, round(y, 6) AS y0, 0.05::DOUBLE AS dx, -0.05::DOUBLE AS dy, NOT (abs(x - x0) > 0.005::DOUBLE OR abs(y - y0) > 0.005::DOUBLE OR abs(abs(dx) - 0.05::DOUBLE) > 1e-5 OR abs(abs(dy) - 0.05::DOUBLE) > 1e-5) AS on_grid FROM s""")
def snapped_lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x0 = k % 400 * F.lit(0.05) + F.when(k % 9 == 0, F.lit(0.02)).otherwise(F.lit(0.00003))
    y0 = F.lit(80.0) - k % 31 * F.lit(0.05) - F.lit(0.00002)
    dy = F.when(k % 11 == 0, F.lit(-0.051)).otherwise(F.lit(-0.05))
    rows = B.read(spark, sf_dir, "customer").select(k.alias("k"), x0.alias("x0"), y0.alias("y0"), F.lit(0.04999998).alias("dx"), dy.alias("dy"))
    return B.rounded(N.snap_lattice(rows, 0.05))


_OFF = 0.00037  # off the parcels' corners: a centre on an edge is in or out by the last bit
_FINE = f"""{B.SLAB_AXES.replace('ax AS (SELECT row_number() OVER (ORDER BY lon) - 1 AS i, lon FROM', f'cx AS (SELECT row_number() OVER (ORDER BY lon) - 1 AS i, lon + {_OFF}::DOUBLE AS lon FROM').replace('ay AS (', 'cy AS (')},
    ex AS (SELECT i, lon - coalesce((lon - lag(lon) OVER o) / 2, (lead(lon) OVER o - lon) / 2, 0.5::DOUBLE) AS lo, lon + coalesce((lead(lon) OVER o - lon) / 2, (lon - lag(lon) OVER o) / 2, 0.5::DOUBLE) AS hi FROM cx WINDOW o AS (ORDER BY lon)),
    ey AS (SELECT j, lat - coalesce((lat - lag(lat) OVER o) / 2, (lead(lat) OVER o - lat) / 2, 0.5::DOUBLE) AS lo, lat + coalesce((lead(lat) OVER o - lat) / 2, (lat - lag(lat) OVER o) / 2, 0.5::DOUBLE) AS hi FROM cy WINDOW o AS (ORDER BY lat)),
    ax AS (SELECT i * 20 + k AS i, lo + (hi - lo) * (k + 0.5::DOUBLE) / 20 AS lon FROM ex, range(20) t(k)), ay AS (SELECT j * 20 + k AS j, lo + (hi - lo) * (k + 0.5::DOUBLE) / 20 AS lat FROM ey, range(20) t(k))"""


@query(f"WITH {_FINE}, {B.PARCELS}, {B.INSIDE} SELECT place_id, i // 20 AS i, j // 20 AS j, round(count(*) / 400.0::DOUBLE, 6) AS weight FROM inside GROUP BY ALL")
def sampled_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = B.slab_axes(spark, sf_dir)
    return B.rounded(N.sampled_share(B.parcel_edges(spark, sf_dir), lon.withColumn("centre", F.col("centre") + _OFF), lat))


@query("""WITH s AS (SELECT o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT l_shipdate::DATE AS date, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END::DOUBLE AS mean FROM lineitem),
    o AS (SELECT date, max(mean) AS mean_external FROM x JOIN (SELECT date, max(ord) AS ord FROM x WHERE mean IS NOT NULL GROUP BY 1) USING (date, ord) GROUP BY 1) SELECT date, n, mean_external FROM s LEFT JOIN o USING (date)""")
def external_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = B.read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    mean = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity").cast("double"))
    other = B.read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), mean.alias("mean"))
    return N.in_order(N.with_daily_mean(days, other))


@query(r"""SELECT c_custkey AS k, regexp_replace(regexp_replace(c_name || ' / ' || c_nationkey || '!', '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS file, CASE WHEN c_custkey % 3 = 0 THEN 'Name_src' WHEN c_custkey % 3 = 1 THEN 'names' ELSE 'GEOMETRY_src' END AS native,
    regexp_matches(lower(c_name), '^[a-z0-9][a-z0-9_-]*$') AS slug, substr(sha1(c_name || '|' || c_nationkey), 1, 12) AS key FROM customer""")
def names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    native = F.when(k % 3 == 0, "Name").when(k % 3 == 1, "names").otherwise("GEOMETRY")
    nation = F.col("c_nationkey").cast("string")
    return B.read(spark, sf_dir, "customer").select(
        k.alias("k"), C.file_safe(F.concat(name, F.lit(" / "), nation, F.lit("!"))).alias("file"), N.native_name(native, ("name", "geometry")).alias("native"), C.is_slug(F.lower(name)).alias("slug"),
        C.mask_key(name, nation).alias("key"))


@query("SELECT 'c' || c_nationkey AS place_id, 1990 + c_custkey % 4 AS year, count(*) FILTER (c_acctbal > 5000 AND c_custkey % 4 <> 2) AS days, count(*) FILTER (c_acctbal > 5000 AND c_custkey % 4 <> 2) = 0 AS empty FROM customer GROUP BY 1, 2")
def empty_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    n = F.when((F.col("c_acctbal") > 5000) & (k % 4 != 2), 3)
    return N.year_contents(B.read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("place_id"), (1990 + k % 4).alias("year"), n.alias("n")))


@query("SELECT min(least(ps, qs)) AS low, max(greatest(ps, qs)) AS high, greatest(0.5::DOUBLE, max(abs(qs - ps))) AS anomaly FROM (SELECT l_quantity::DOUBLE AS ps, l_quantity::DOUBLE + l_linenumber AS qs FROM lineitem)")
def map_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    return S.shared_domain(B.read(spark, sf_dir, "lineitem").select(q.alias("then"), (q + F.col("l_linenumber")).alias("now")))


@query("SELECT year(o_orderdate) AS year, count(*) AS n, CASE year(o_orderdate) WHEN 1997 THEN 'now' WHEN 1996 THEN 'previous' WHEN 1993 THEN 'then' WHEN 1994 THEN 'then' ELSE 'other' END AS line FROM orders GROUP BY 1")
def chart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = B.read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return S.chart_lines(years, (1993, 1994), 1997)


# places and grids in files
def _written_places(spark: SparkSession, sf_dir: str, order: str) -> str:
    """Parcels as GeoParquet, in the shared folder."""
    rows = B.parcels(spark, sf_dir).select("place_id", F.concat(F.lit("g"), F.length("place_id")).alias("authority"), F.concat(F.lit("parcel "), "place_id").alias("name"), (F.length("place_id") * 1.5).alias("area_km2"), parts_wkb("parts").alias("geometry"))
    path = fresh_path(spark, "places")
    P.write_places(rows.withColumn("bbox", wkb_box("geometry")), path, order=order, row_group=20)
    return path


_PARCEL_BOX = f"WITH {B.PARCELS}, b AS (SELECT place_id, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM pe GROUP BY 1)"


@query(f"{_PARCEL_BOX} SELECT 'g' || length(place_id) AS gazetteer, place_id, 'parcel ' || place_id AS name, length(place_id) * 1.5::DOUBLE AS area_km2, round(x0, 6) AS x0, round(y1, 6) AS y1 FROM b")
def places_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six columns of written places, in order."""
    rows = P.scan_places(spark, _written_places(spark, sf_dir, "id"))
    return rows.select("gazetteer", "place_id", "name", "area_km2", F.round("bbox.xmin", 6).alias("x0"), F.round("bbox.ymax", 6).alias("y1"))


@query(f"{_PARCEL_BOX} SELECT place_id, round(x0, 6) AS x0, round(y0, 6) AS y0 FROM b WHERE x1 >= {B.LON0 + 0.21} AND x0 <= {B.LON0 + 0.34} AND y1 >= {B.LAT0 + 0.11} AND y0 <= {B.LAT0 + 0.3}")
def places_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.places_in_box(spark, _written_places(spark, sf_dir, "space"), B.LON0 + 0.21, B.LAT0 + 0.11, B.LON0 + 0.34, B.LAT0 + 0.3)
    return found.select("place_id", F.round("bbox.xmin", 6).alias("x0"), F.round("bbox.ymin", 6).alias("y0"))


@query(f"WITH {B.SLAB} SELECT time::DATE AS date, count(*) AS n, round(sum(value), 4) AS total FROM slab WHERE latitude BETWEEN {B.LAT0 + 0.12} AND {B.LAT0 + 0.44} AND longitude >= {B.LON0 + 0.08} AND longitude < {B.LON0 + 0.33} AND time >= (SELECT min(time)::DATE + 5 FROM slab) AND time < (SELECT min(time)::DATE + 12 FROM slab) GROUP BY 1")
def gridded_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box and a week of a dataset behind requests: the filters become one request for each slice of days."""
    slab = B.slab(spark, sf_dir)
    first, last = slab.agg(F.min(F.to_date("time")), F.max(F.to_date("time"))).first()
    base = fresh_path(spark, "mirror")
    slab.select("time", "latitude", "longitude", "value").write.parquet(f"{base}/griddap/slab.parquet")
    rows = read_gridded(spark, base=base, dataset="slab", variable="value", start=first.isoformat(), end=last.isoformat(), slice_days=4)
    day = lambda n: F.lit((first + timedelta(n)).isoformat()).cast("timestamp")
    box = F.col("latitude").between(B.LAT0 + 0.12, B.LAT0 + 0.44) & (F.col("longitude") >= B.LON0 + 0.08) & (F.col("longitude") < B.LON0 + 0.33)
    return rows.where(box & (F.col("time") >= day(5)) & (F.col("time") < day(12))).groupBy(F.to_date("time").alias("date")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# rings
_TURN = f"""{B.PARCELS}, far AS (SELECT place_id, part, ring, px + {179.93 - B.LON0}::DOUBLE - 0.05::DOUBLE * (s_suppkey % 3) AS px, py, qx + {179.93 - B.LON0}::DOUBLE - 0.05::DOUBLE * (s_suppkey % 3) AS qx, qy FROM pe JOIN parcel USING (place_id)),
    w AS (SELECT *, unnest([0, 1]) AS world FROM far), c AS (SELECT *, greatest(least(px, qx), -180 + 360 * world) AS a, least(greatest(px, qx), 180 + 360 * world) AS b FROM w)"""


@query(f"""WITH {_TURN} SELECT place_id, part, ring, world, round(abs(sum(sign(qx - px) * (b - a) * (py + (a - px) * (qy - py) / (qx - px) + py + (b - px) * (qy - py) / (qx - px)) / 2)), 9) AS area
    FROM c WHERE b > a GROUP BY ALL HAVING area > 1e-8""")
def antimeridian_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels moved to the antimeridian, folded to [-180, 180] and split: the area of each piece."""
    key = F.substring("place_id", 2, 20).cast("long") % 3
    edges = B.parcel_edges(spark, sf_dir).withColumn("off", F.lit(179.93 - B.LON0) - F.lit(0.05) * key)
    closing = F.max(F.struct("k", F.col("bx").alias("x"), F.col("by").alias("y"))).alias("end")
    by = ["place_id", "part", "ring"]
    last = edges.groupBy(*by, "off").agg(closing).select(*by, "off", (F.col("end.k") + 1).alias("k"), "end.x", "end.y")
    points = edges.select(*by, "off", "k", F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(last).withColumn("x", F.col("x") + F.col("off")).drop("off")
    folded = points.withColumn("x", F.when(F.col("x") > 180, F.col("x") - 360).otherwise(F.col("x")))
    pieces = G.split_vertices(folded, by)
    along = Window.partitionBy(*by, "world").orderBy("k")
    step = (F.lead("x").over(along) - F.col("x")) * (F.lead("y").over(along) + F.col("y")) / 2
    side = F.when(F.col("x") > 0, 0).otherwise(1)
    sums = pieces.withColumn("step", step).groupBy(*by, "world").agg(F.round(F.abs(F.sum("step")), 9).alias("area"), F.min(side).alias("side")).where("area > 1e-8")
    return sums.select(*by, F.col("side").alias("world"), "area")


@query(f"WITH {B.PARCELS} SELECT DISTINCT place_id AS feature, part * 2 AS part, ring AS ring_no, count(*) OVER (PARTITION BY place_id, part, ring) + 1 AS points FROM pe")
def nested_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels' rings without their order, shells clockwise: holes find their shells."""
    rings = B.parcels(spark, sf_dir).select("place_id", F.posexplode("parts").alias("part", "rings")).select("place_id", "part", F.posexplode("rings").alias("r", "ring"))
    flat = rings.select(F.col("place_id").alias("feature"), (F.col("part") * 2 + F.col("r")).alias("k"), F.when(F.col("r") == 0, F.reverse("ring")).otherwise(F.col("ring")).alias("ring"))
    return G.nested_rings(flat).select("feature", "part", "ring_no", F.size("ring").cast("long").alias("points"))


@query(f"WITH {B.PARCELS} SELECT place_id, 2::BIGINT AS parts, 14::BIGINT AS points, round(1.28::DOUBLE * dx * dy, 9) AS area FROM parcel")
def cleaned_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes that overlap, as one self-crossing place: by the even-odd rule two parts of seven points are left."""
    corners = ((0.0, 0.0, 1.0, 1.0), (0.5, 0.4, 1.3, 1.5))
    places = cleaned(B.parcel_of_boxes(spark, sf_dir, corners))
    rings = places.select("place_id", F.size("parts").cast("long").alias("parts"), F.explode("parts").alias("rings")).select("place_id", "parts", F.explode("rings").alias("ring"))
    sums = rings.groupBy("place_id", "parts").agg(F.sum(F.size("ring")).cast("long").alias("points"), F.round(-F.sum(G.ring_turn(F.col("ring"))) / 2, 9).alias("area"))
    return sums.select("place_id", "parts", "points", "area")


# series that are kept up to date
@query(SQL["assemble_dedupe"])
def assemble_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of chunk files, one at a time."""
    rows = B.chunks(spark, sf_dir).withColumn("place_id", F.lit("p"))
    chunks, out, at = (fresh_path(spark, kind) for kind in ("chunks", "series", "progress"))
    rows.repartition(5, "span_start").write.parquet(chunks)
    stream = read_chunks(spark, chunks, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes))
    write_assembled(stream, out, at).awaitTermination()
    identity = {"place_id": "pid", "dataset_id": "ds", "variable": "v"}
    return B.rounded(spark.read.parquet(out).select("date", "n", "mean", *[F.lit(v).alias(c) for c, v in identity.items()]))


@query("SELECT 'd' || (o_custkey % 40) AS dataset, min(o_orderdate)::DATE AS first, greatest(min(o_orderdate)::DATE, max(o_orderdate)::DATE - 29) AS start, max(o_orderdate)::DATE AS end FROM orders GROUP BY 1")
def record_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    extents = B.read(spark, sf_dir, "orders").groupBy(F.concat(F.lit("d"), F.col("o_custkey") % 40).alias("dataset")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    return I.record_windows(extents.withColumn("first", F.to_date("start")), 30).select("dataset", "first", "start", "end")


@query("""WITH u AS (SELECT c_custkey AS unit, 'h' || (c_custkey % 7) AS host FROM customer),
    a AS (SELECT o_custkey AS unit, 'h' || (o_custkey % 7) AS host, o_orderkey AS t, o_orderkey % 3 = 0 AS ok, CASE o_orderkey % 3 WHEN 1 THEN 'HTTP 503 busy' WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'no such variable' ELSE 'fetch failed' END END AS message FROM orders WHERE o_custkey % 7 <> 5 OR o_orderkey % 3 = 1),
    k AS (SELECT *, CASE WHEN ok THEN NULL WHEN message LIKE 'HTTP 5%' THEN '5xx' WHEN message = 'fetch failed' THEN 'network' END AS kind FROM a),
    own AS (SELECT unit, arg_max(ok, t) AS ok, arg_max(coalesce(kind, '-'), t) AS kind, arg_max(coalesce(message, '-'), t) AS message, count(*) FILTER (NOT ok AND kind IS NOT NULL) AS tries FROM k GROUP BY 1),
    hs AS (SELECT host, arg_max(ok, t) AS ok, arg_max(coalesce(kind, '-'), t) AS kind FROM k GROUP BY 1)
    SELECT unit, host, CASE WHEN own.ok THEN 'completed' WHEN own.kind <> '-' THEN 'skipped' WHEN own.unit IS NOT NULL THEN 'error' WHEN NOT hs.ok AND hs.kind <> '-' THEN 'skipped' ELSE 'deferred' END AS status,
           CASE WHEN own.unit IS NOT NULL THEN CASE WHEN NOT own.ok AND own.kind <> '-' THEN own.kind END WHEN NOT hs.ok AND hs.kind <> '-' THEN hs.kind END AS kind, coalesce(tries, 0) AS tries,
           CASE WHEN own.ok THEN NULL WHEN own.unit IS NOT NULL THEN own.message WHEN NOT hs.ok AND hs.kind <> '-' THEN 'not reached: host still down' END AS reason
    FROM u LEFT JOIN own USING (unit) LEFT JOIN hs USING (host)""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.concat(F.lit("h"), F.col("c_custkey") % 7).alias("host"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    message = F.when(k % 3 == 1, "HTTP 503 busy").when(k % 3 == 2, F.when(k % 2 == 0, "no such variable").otherwise("fetch failed"))
    attempts = B.read(spark, sf_dir, "orders").where((c % 7 != 5) | (k % 3 == 1)).select(c.alias("unit"), F.concat(F.lit("h"), c % 7).alias("host"), k.alias("at"), (k % 3 == 0).alias("ok"), message.alias("message"))
    return K.outcomes(units, attempts)


# lists, names, frames and lattices
@query(f"""WITH {B.INDEX}, o AS (SELECT *, CASE collection WHEN 'sanctuaries' THEN 0 ELSE 1 END AS c, collection = 'sanctuaries' AS shown FROM idx)
    SELECT place_id, name, collection, shown, row_number() OVER (ORDER BY c, rank, collection, name, place_id) AS place, more FROM (
        SELECT *, row_number() OVER (PARTITION BY collection ORDER BY name, place_id) AS k, greatest(count(*) OVER (PARTITION BY collection) - 20, 0) AS more FROM o) WHERE k <= 20""")
def curated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = B.index(spark, sf_dir)
    manifest = index.select(F.col("collection").alias("slug"), "rank").distinct()
    shown = K.sections(K.group_ranks(index.drop("rank"), manifest, ("sanctuaries", "absent")), 20)
    number = F.row_number().over(Window.orderBy("group_order", "place")).cast("long")  # capped lists: few rows
    return shown.select("place_id", "name", "collection", "shown", number.alias("place"), "more")


@query(r"""SELECT c_custkey AS k, regexp_replace(concat_ws('_', 'stats', 'c' || c_nationkey || '-x', CASE WHEN c_custkey % 3 > 0 THEN 'v' || (c_custkey % 5) END, nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '2026-01-0' || (c_custkey % 9 + 1) END, '')), '\s', '') || '.csv' AS file,
    CASE WHEN c_custkey % 720 - 360 < 0 THEN c_custkey % 720 ELSE c_custkey % 720 - 360 END::DOUBLE AS raw, least(greatest(least(w, e), 0.125), 359.875)::DOUBLE AS west, least(greatest(greatest(w, e), 0.125), 359.875)::DOUBLE AS east
    FROM (SELECT *, CASE WHEN c_custkey % 360 - 180 < 0 THEN c_custkey % 360 + 180 ELSE c_custkey % 360 - 180 END AS w, CASE WHEN c_custkey % 360 - 170 < 0 THEN c_custkey % 360 + 190 ELSE c_custkey % 360 - 170 END AS e FROM customer)""")
def result_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = C.result_name("stats", ".csv", F.concat(F.lit("c"), F.col("c_nationkey"), F.lit(":x ")), F.when(k % 3 > 0, F.concat(F.lit("v"), k % 5)), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("2026-01-0"), k % 9 + 1)))
    span = C.lobe_span((k % 360 - 180).cast("double"), (k % 360 - 170).cast("double"), F.lit(0.125), F.lit(359.875))
    raw = C.lobe_span((k % 720 - 360).cast("double"), (k % 720 - 360).cast("double"), F.lit(-1000.0), F.lit(1000.0))["west"]
    return B.read(spark, sf_dir, "customer").select(k.alias("k"), name.alias("file"), F.when(raw < 0, raw + 360).otherwise(raw).alias("raw"), span["west"].alias("west"), span["east"].alias("east"))


@query("""WITH r AS (SELECT 's' || s_suppkey AS place_id, 3 + s_suppkey % 5 AS w, 2 + s_suppkey % 3 AS h, s_suppkey::DOUBLE AS west FROM supplier)
    SELECT place_id, 'lon' AS axis, k::INTEGER AS k, round(west + (k + 0.5::DOUBLE) * (2.0::DOUBLE / w), 6) AS centre FROM r, range(10) t(k) WHERE k < w
    UNION ALL SELECT place_id, 'lat', k::INTEGER, round(7.5::DOUBLE - (k + 0.5::DOUBLE) * (1.5::DOUBLE / h), 6) FROM r, range(10) t(k) WHERE k < h""")
def lattice_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rasters = B.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k).alias("place_id"), (3 + k % 5).alias("width"), (2 + k % 3).alias("height"), k.cast("double").alias("west"), F.lit(6.0).alias("south"), (k.cast("double") + 2).alias("east"), F.lit(7.5).alias("north"))
    return B.rounded(N.lattice_axes(rasters))


@query(f"""WITH {B.SLAB_AXES}, {B.PARCELS}, {B.INSIDE}, r AS (SELECT place_id, x0 AS west, y0 AS south, x0 + 0.3::DOUBLE AS east, y0 + 0.4::DOUBLE AS north FROM parcel)
    SELECT place_id, row, col, count(*) AS cells FROM (SELECT place_id, floor((north - lat) / (north - south) * 4)::INTEGER AS row, floor((lon - west) / (east - west) * 3)::INTEGER AS col FROM inside JOIN r USING (place_id)) WHERE row BETWEEN 0 AND 3 AND col BETWEEN 0 AND 2 GROUP BY ALL""")
def cells_on_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = B.parcel_corners(spark, sf_dir)
    rasters = boxes.select("place_id", F.lit(3).alias("width"), F.lit(4).alias("height"), F.col("x0").alias("west"), F.col("y0").alias("south"), (F.col("x0") + 0.3).alias("east"), (F.col("y0") + 0.4).alias("north"))
    cells = M.grid_mask(B.parcel_edges(spark, sf_dir), *B.slab_axes(spark, sf_dir), weights=False)
    return N.on_lattice(cells, rasters).groupBy("place_id", "row", "col").agg(F.count("*").alias("cells"))


@query(f"""WITH {B.SLAB} , c AS (SELECT DISTINCT event_type, round(longitude::DOUBLE, 4) AS lon, round(latitude::DOUBLE, 4) AS lat FROM slab),
    x AS (SELECT event_type, coalesce(median(g), 0) AS dx FROM (SELECT event_type, lon - lag(lon) OVER (PARTITION BY event_type ORDER BY lon) AS g FROM (SELECT DISTINCT event_type, lon FROM c)) GROUP BY 1),
    y AS (SELECT event_type, coalesce(median(g), 0) AS dy FROM (SELECT event_type, lat - lag(lat) OVER (PARTITION BY event_type ORDER BY lat) AS g FROM (SELECT DISTINCT event_type, lat FROM c)) GROUP BY 1)
    SELECT event_type, round(CASE WHEN dx > 0 THEN dx ELSE dy END, 6) AS dx, round(CASE WHEN dy > 0 THEN dy ELSE dx END, 6) AS dy FROM x JOIN y USING (event_type)""")
def cell_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = B.slab(spark, sf_dir).select("event_type", F.round(F.col("longitude").cast("double"), 4).alias("longitude"), F.round(F.col("latitude").cast("double"), 4).alias("latitude"))
    return B.rounded(N.spacings(cells, ["event_type"]))


@query(f"WITH {B.DAILY}, s AS (SELECT year(date) AS year, dayofyear(make_date(2000, month(date), day(date))) AS band, mean FROM raw) SELECT band, round(avg(mean), 6) AS clim, 'clim' AS line FROM s WHERE year BETWEEN 1995 AND 1998 GROUP BY 1")
def then_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(S.then_line(S.series_by_day(B.daily_orders(spark, sf_dir), (1995, 1998))))


@query(f"""WITH {B.ITEMS}, m AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'partial' ELSE 'complete' END AS status FROM items WHERE k % 4 <> 0)
    SELECT collection, strftime(min(start), '%Y-%m-%dT00:00:00Z') AS first, strftime(max("end"), '%Y-%m-%dT00:00:00Z') AS last, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'partial') AS partial, any_value(p) AS pending,
           array_to_string(list_sort(list(DISTINCT variable)), ',') AS variables, min((k % 300)::DOUBLE - 170) AS west FROM m JOIN (SELECT collection, count(*) AS p FROM items WHERE k % 4 = 0 GROUP BY 1) USING (collection) GROUP BY 1""")
def stac_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of collections, and what they say."""
    all_ = B.items(spark, sf_dir)
    west = (F.col("k") % 300).cast("double") - 170
    made = all_.where("k % 4 <> 0").withColumns({"status": F.when(F.col("k") % 3 == 0, "partial").otherwise("complete"), "dataset_id": F.col("collection"), "west": west, "south": F.lit(1.0), "east": west + 1, "north": F.lit(2.0)})
    doc = F.from_json("body", "extent struct<spatial: struct<bbox: array<array<double>>>, temporal: struct<interval: array<array<string>>>>, summaries struct<variable: array<string>>, item_counts struct<complete: long, partial: long, pending: long>")
    rows = W.collections(made, all_).select("collection", doc.alias("d"))
    return rows.select("collection", F.col("d.extent.temporal.interval")[0][0].alias("first"), F.col("d.extent.temporal.interval")[0][1].alias("last"), "d.item_counts.*", F.array_join("d.summaries.variable", ",").alias("variables"), F.col("d.extent.spatial.bbox")[0][0].alias("west"))


# files of a run
@query(f"WITH {B.CHUNKS} SELECT span_start, span_end, count(*) AS rows, min(date) AS first, round(avg(mean), 6) AS mean FROM chunk GROUP BY ALL")
def file_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in files that are named by their spans."""
    path = fresh_path(spark, "chunks")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    name = F.concat(day("span_start"), F.lit("_"), day("span_end"), F.lit(".parquet"))
    B.chunks(spark, sf_dir).withColumn("file", name).drop("span_start", "span_end").repartition("file").write.partitionBy("file").parquet(path)
    rows = I.with_file_spans(spark.read.parquet(path))
    return B.rounded(rows.groupBy("span_start", "span_end").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.avg("mean").alias("mean")))


@query(f"WITH {B.SLAB} SELECT event_type, count(*) AS n, count(DISTINCT latitude > 20.3::FLOAT) AS lobes, round(sum(value), 4) AS total, (SELECT count(*) FROM slab) AS written FROM slab GROUP BY 1")
def lobe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slab's lobes as files of their own, read as one table with the file of each row, and the rows that were written."""
    path, slab = fresh_path(spark, "lobes"), B.slab(spark, sf_dir)
    north = F.col("latitude") > F.lit(20.3).cast("float")
    for lobe, rows in (("N", slab.where(north)), ("S", slab.where(~north))):
        rows.coalesce(1).write.parquet(f"{path}/{lobe}")
    read = R.slabs(spark, f"{path}/N", f"{path}/S")
    n = sum(R.row_count(spark, f"{path}/{lobe}") for lobe in "NS")
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("lobes"), F.round(F.sum("value"), 4).alias("total"), F.lit(n).cast("long").alias("written"))


@query(f"{_CELLS} SELECT place_id, count(*) AS cells, round(sum(CASE WHEN i % 3 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END), 6) AS weight FROM inside WHERE i % 3 < 2 GROUP BY 1")
def masks_of_lobes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks that overlap, one of them from CSV files, put together: a cell counts once, with its larger weight."""
    lon, lat = B.slab_axes(spark, sf_dir)
    inside = M.inside_scan(B.parcel_edges(spark, sf_dir), M.axis_edges(lon), M.axis_edges(lat))
    named = lambda df, w: df.select("place_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit(w).alias("weight"))
    path = fresh_path(spark, "mask")
    named(inside.where("i % 3 = 0"), 0.5).write.option("header", True).csv(path)  # a file for each task, not for each place
    whole = A.joined_lobes(named(inside.where("i % 3 < 2"), 0.25), R.mask_csv(spark, path, keyed=True))
    return B.rounded(whole.groupBy("place_id").agg(F.count("*").alias("cells"), F.sum("weight").alias("weight")))


@query(f"""WITH p AS (SELECT 'p' || (l_linenumber % 2) AS place_id, l_suppkey % 8 AS row, l_partkey % 8 AS col, l_shipdate::TIMESTAMP + to_hours((l_orderkey % 5)::INTEGER) AS t, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
    c AS (SELECT place_id, year(t)::INTEGER AS year, dayofyear(make_date(2000, month(t), day(t)))::INTEGER AS band, row, col, arg_max(value, t) AS value FROM p GROUP BY ALL)
    SELECT place_id, year, count(*) AS n, count(DISTINCT band) AS bands, round(sum(value * {B.UNEVEN}::DOUBLE), 2) AS total FROM c GROUP BY ALL""")
def cube_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of several times a day on the leap calendar: a day takes its latest."""
    rows = B.read(spark, sf_dir, "lineitem")
    at = F.to_date("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("l_orderkey") % 5).cast("int"))
    pixels = rows.groupBy(F.concat(F.lit("p"), F.col("l_linenumber") % 2).alias("place_id"), (F.col("l_suppkey") % 8).alias("row"), (F.col("l_partkey") % 8).alias("col"), at.alias("date")).agg(F.avg("l_extendedprice").alias("value"))
    return S.cube_bands(pixels).groupBy("place_id", "year").agg(F.count("*").alias("n"), F.count_distinct("band").alias("bands"), F.round(F.sum(F.col("value") * B.UNEVEN), 2).alias("total"))


@query(f"""WITH {B.CUBE}, pts AS (SELECT c_custkey AS k, (c_custkey % 97)::DOUBLE / 10 - 81.3::DOUBLE AS lon, (c_custkey % 89)::DOUBLE / 9 + 23.1::DOUBLE AS lat FROM customer WHERE c_custkey % 5 = 0),
    at AS (SELECT k, floor((lon + 80) / (8.0::DOUBLE / 8)) AS col, floor((31.5::DOUBLE - lat) / (6.5::DOUBLE / 8)) AS row FROM pts WHERE lon BETWEEN -80 AND -72 AND lat BETWEEN 25 AND 31.5)
    SELECT k, place_id, round(value, 6) AS value FROM at JOIN (SELECT * FROM cube WHERE year = 1996 AND band = 100) USING (row, col)""".replace(" at AS", " spot AS").replace("FROM at ", "FROM spot "))
def value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = B.read(spark, sf_dir, "customer").where(k % 5 == 0).select(k.alias("k"), ((k % 97).cast("double") / 10 - 81.3).alias("lon"), ((k % 89).cast("double") / 9 + 23.1).alias("lat"))
    return B.rounded(S.value_at(B.cube(spark, sf_dir).where("year = 1996 and band = 100"), points, (-80.0, 25.0, -72.0, 31.5), 8, 8).select("k", "place_id", "value"))


@query(f"""WITH {B.SLAB}, {B.AXES}, {B.BOX_MASK}, {B.JOINED}, cells AS (SELECT time::DATE AS date, length(event_type)::BIGINT AS class, weight FROM joined), t AS (SELECT date, count(*) AS nt, sum(weight) AS wt FROM cells GROUP BY 1)
    SELECT date, class, round(sum(weight) / any_value(wt), 6) AS frac_area, round(100.0::DOUBLE * count(*) / any_value(nt), 6) AS pct_cells FROM cells JOIN t USING (date) GROUP BY date, class""")
def published_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = A.stats_categorical(B.slab(spark, sf_dir), B.box_mask(spark), F.length("event_type") + 0.25)
    return B.rounded(A.published(A.as_queried(A.published(classes))).select("date", "class", "frac_area", "pct_cells"))


@query("SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'multipolygon' WHEN 2 THEN 'MultiPoint' WHEN 3 THEN 'Polygons' END AS kind, coalesce(c_custkey % 5 < 2, false) AS polygonal FROM customer")
def polygonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 0, "Polygon").when(k % 5 == 1, "multipolygon").when(k % 5 == 2, "MultiPoint").when(k % 5 == 3, "Polygons")
    return B.read(spark, sf_dir, "customer").select(k.alias("k"), kind.alias("kind"), F.coalesce(C.is_polygonal(kind), F.lit(False)).alias("polygonal"))
