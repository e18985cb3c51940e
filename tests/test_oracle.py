"""Every registered query of the engine against its SQL."""

import glob
import math
import os

import duckdb
import pytest

from zonestat.plans.queries import QUERIES, SQL


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        return
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: KINDS.get(kind, kind) for c, kind in df.dtypes} == kinds
    assert sorted(names) == sorted(df.columns)
    assert rows_of(got, df.columns) == rows_of(cursor.fetchall(), names)


@pytest.mark.parametrize(
    ("name", "keys"),
    [("stats_daily", ["date"]), ("stats_daily_places", ["place_id", "date"]), ("stats_categorical", ["date", "class"]), ("stats_monthly_points", ["date"]), ("points_station", ["latitude", "longitude"]), ("last_step", ["latitude", "longitude"]), ("series_doy", ["year", "band"]), ("grid_mask_scan", ["place_id", "latitude", "longitude"]), ("grid_mask_weights", ["place_id", "latitude", "longitude"])],
)
def test_results_come_in_order(spark, sf, name, keys):
    rows = [tuple(r[k] for k in keys) for r in QUERIES[name](spark, sf.replace("sf0.001", "sf0.01")).collect()]
    assert rows == sorted(rows) and len(rows) > 1
