"""WKB in columns, GeoParquet places and the gridded source."""

import json
import random
import struct
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from zonestat.functions import wkb as W
from zonestat.sources import gridded as G
from zonestat.sources import places as P


def polygon(order, *rings, srid=False, z=False, code=3):
    pack = lambda f, *v: struct.pack(order + f, *v)
    kind = code | (0x20000000 if srid else 0) | (0x80000000 if z else 0)
    out = bytes([order == "<"]) + pack("I", kind) + (pack("I", 4326) if srid else b"") + pack("I", len(rings))
    for ring in rings:
        out += pack("I", len(ring)) + b"".join(pack("ddd" if z else "dd", *p, *([9.0] if z else [])) for p in ring)
    return out


RING = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
HOLE = [(0.2, 0.1), (0.6, 0.1), (0.6, 0.4), (0.2, 0.1)]
POINT = b"\x01" + struct.pack("<Idd", 1, 5, 6)
MULTI = b"\x01" + struct.pack("<II", 6, 2) + polygon("<", RING) + polygon(">", RING, HOLE)
MIXED = b"\x00" + struct.pack(">II", 7, 3) + POINT + polygon("<", RING, z=True) + MULTI
VALUES = [polygon("<", RING), polygon(">", RING, srid=True), polygon("<", RING, z=True), polygon("<", RING, z=False, code=3), MULTI, MIXED, POINT, None, b"", b"\x01\x02", b"\x07" + POINT[1:], b"\x01" + struct.pack("<I", 99), polygon("<", RING)[:-3], MULTI[:-20]]
PARTS = [1, 1, 1, 1, 2, 3, 0, None, None, None, None, None, None, None]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(list(enumerate(VALUES)), "place_id int, geometry binary").repartition(3)


def test_wkb_parts(values):
    got = values.select("place_id", W.wkb_parts("geometry").alias("p"), W.wkb_box("geometry").alias("b")).orderBy("place_id").collect()
    assert [None if r["p"] is None else len(r["p"]) for r in got] == PARTS
    assert all([(p["x"], p["y"]) for p in r["p"][0][0]] == RING for r in got[:5])
    assert [[(p["x"], p["y"]) for p in ring] for ring in got[4]["p"][1]] == [RING, HOLE]
    assert tuple(got[5]["b"]) == (0.0, 0.0, 1.0, 1.0) and got[6]["b"] is None and got[9]["b"] is None


def test_wkb_edges(values):
    from zonestat.operators.mask import edges_from_parts

    got = W.wkb_edges(values).cache()
    bad = {r["place_id"]: r["reason"] for r in got.where("reason is not null").collect()}
    assert set(bad) == {8, 9, 10, 11, 12, 13} and bad[11] == "unknown geometry type 99" and bad[10] == "unknown byte order 7"
    want = edges_from_parts(values.select("place_id", W.wkb_parts("geometry").alias("parts")))
    key = lambda df: sorted(tuple(r[c] for c in ("place_id", "part", "ring", "k", "ax", "ay", "bx", "by")) for r in df.collect())
    assert key(got.where("reason is null")) == key(want) and want.count() == 3 * (4 + 3 + 4)


def test_wkb_round_trip(spark):
    rows = [(0, [[RING, HOLE], [RING]]), (1, []), (2, None)]
    shaped = [(k, None if v is None else [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in v]) for k, v in rows]
    df = spark.createDataFrame(shaped, "k int, p array<array<array<struct<x: double, y: double>>>>")
    back = {r["k"]: r["p"] for r in df.select("k", W.wkb_parts(W.parts_wkb("p")).alias("p")).collect()}
    assert {k: None if v is None else [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in v] for k, v in back.items()} == dict(rows)


def test_a_polygon_is_read_without_a_step_for_each_point():
    rng = random.Random(1)
    ring = [(rng.random(), rng.random()) for _ in range(2000)]
    column = pa.array([polygon("<", ring)] * 2000, pa.binary())
    began = time.perf_counter()
    found, _ = W.rings_of(column)
    assert len(found) == 2000 and len(found[7][0][2]) == 2000
    assert time.perf_counter() - began < 2  # four million points


def carried(spark, n=9000):
    """Places in a swarm, some across 180."""
    x, y = F.col("id") * 37 % 3500 / 10 - 178.5, F.col("id") * 91 % 1700 / 10 - 85
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(point(0, 0), point(0.4, 0.1), point(0.3, 0.5), point(0, 0))
    rows = spark.range(n).select(F.format_string("p%05d", "id").alias("place_id"), F.concat(F.lit("g"), F.col("id") % 3).alias("authority"), F.concat(F.lit("place "), F.col("id") % 700).alias("name"), (F.col("id") * 1.5).alias("area_km2"), F.lit("unused").alias("status"), W.parts_wkb(F.array(F.array(ring))).alias("geometry"))
    return rows.withColumn("bbox", W.wkb_box("geometry"))


def scanned(df):
    """Rows that the scan gave, and what it read, from its plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            found.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        for k in range(kids.size()):
            walk(kids.apply(k))

    walk(plan)
    return sum(found)


@pytest.mark.parametrize("order", ["id", "space"])
def test_places_are_written_and_looked_up(spark, tmp_path, order):
    path, rows = str(tmp_path / "places"), carried(spark)
    P.write_places(rows, path, order=order, row_group=500, provenance={"from": "here"}, files=2)
    files = sorted((tmp_path / "places").glob("part-*.parquet"))
    assert len(files) == 2 and not list((tmp_path / "places").glob("_pending*")) and (tmp_path / "places/_SUCCESS").exists()
    for f in files:
        meta = pq.ParquetFile(f).metadata
        geo = json.loads(meta.metadata[b"geo"])
        column = geo["columns"][geo["primary_column"]]
        assert geo["version"] == "1.1.0" and column["encoding"] == "WKB" and column["geometry_types"] == ["MultiPolygon"]
        assert column["covering"]["bbox"]["xmin"] == ["bbox", "xmin"] and len(column["bbox"]) == 4
        assert json.loads(meta.metadata[b"places:provenance"]) == {"from": "here"}
        groups = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
        assert all(n == 500 for n in groups[:-1]) and groups[-1] <= 500 and len(groups) > 5
    assert spark.read.parquet(path).count() == 9000
    box = (10.0, 10.0, 14.0, 20.0)
    want = {r["place_id"] for r in rows.where((F.col("bbox.xmax") >= box[0]) & (F.col("bbox.xmin") <= box[2]) & (F.col("bbox.ymax") >= box[1]) & (F.col("bbox.ymin") <= box[3])).collect()}
    found = P.places_in_box(spark, path, *box)
    assert {r["place_id"] for r in found.collect()} == want and want
    across = P.places_in_box(spark, path, 170.0, -90.0, -175.0, 90.0)
    assert across.count() == rows.where("bbox.xmax >= 170 or bbox.xmin <= -175").count() > 0
    one = P.place_by_id(spark, path, "p04321")
    assert [r["place_id"] for r in one.collect()] == ["p04321"]
    if order == "id":
        assert scanned(one) <= 500
    else:
        assert scanned(found) <= 3000


@pytest.mark.parametrize("n", [19, 20, 40, 41])
def test_places_that_fill_whole_row_groups(spark, tmp_path, n):
    path = str(tmp_path / "places")
    P.write_places(carried(spark, n), path, order="id", row_group=20, files=1)
    (file,) = (tmp_path / "places").glob("part-*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(k).num_rows for k in range(meta.num_row_groups)] == [20] * (n // 20) + [n % 20] * (n % 20 > 0)
    assert sorted(r["place_id"] for r in P.scan_places(spark, path).collect()) == sorted(r["place_id"] for r in carried(spark, n).collect())


def test_projected_scan(spark, tmp_path):
    path = str(tmp_path / "places")
    P.write_places(carried(spark, 900), path)
    got = P.scan_places(spark, path)
    assert got.columns == P.PLACE
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "status" not in plan.split("ReadSchema")[1]
    rows = got.collect()
    assert [(r["gazetteer"], r["name"]) for r in rows] == sorted((r["gazetteer"], r["name"]) for r in rows) and len(rows) == 900


def test_overwriting_replaces_all_files(spark, tmp_path):
    path = str(tmp_path / "places")
    P.write_places(carried(spark, 900), path, files=3)
    P.write_places(carried(spark, 300), path, files=1)
    assert spark.read.parquet(path).count() == 300
    P.write_places(carried(spark, 10).limit(0), path)
    assert not list((tmp_path / "places").glob("part-*"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "places")
    P.write_places(carried(spark, 300), path, files=1)
    broken = carried(spark, 300).withColumn("name", F.when(F.col("place_id") == "p00299", F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        P.write_places(broken, path, files=2)
    assert spark.read.parquet(path).count() == 300


def test_circle_box():
    import numpy as np

    box = lambda *rows: P.circle_box(np.array(rows, float))
    assert box((170, 0, 180, 5), (-180, 1, -175, 9)) == [170, 0, -175, 9]
    assert box((-10, 0, 5, 5), (20, 1, 30, 9)) == [-10, 0, 30, 9]
    assert P.circle_box(np.zeros((0, 4))) is None


@pytest.fixture(scope="module")
def mirror(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("mirror")
    rows = spark.sql(
        "SELECT timestampadd(DAY, d, timestamp'2026-01-01 12:00:00') AS time, 20 + 0.25 * y AS latitude, -160 + 0.25 * x AS longitude, double(d * 10000 + y * 100 + x) AS sst "
        "FROM (SELECT explode(sequence(0, 119)) AS d) CROSS JOIN (SELECT explode(sequence(0, 19)) AS y) CROSS JOIN (SELECT explode(sequence(0, 39)) AS x)"
    )
    rows = rows.select("time", F.col("latitude").cast("double"), F.col("longitude").cast("double"), "sst")
    rows.repartitionByRange(6, "time").sortWithinPartitions("time").write.parquet(str(root / "griddap/oisst.parquet"))
    return str(root), rows.cache()


def grid(spark, mirror, **more):
    return G.read_gridded(spark, base=mirror[0], dataset="oisst", variable="sst", start="2026-01-01", end="2026-04-30", slice_days=30, **more)


def pushed(mirror):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

    reader = G.GriddedReader({"base": mirror[0], "dataset": "oisst", "variable": "sst", "start": "2026-01-01", "end": "2026-04-30"}, type("S", (), {"names": ["time", "latitude", "longitude", "sst"]}))
    list(reader.pushFilters([GreaterThanOrEqual(("time",), G._instant("2026-02-10")), LessThanOrEqual(("time",), G._instant("2026-02-20T23:00:00")), GreaterThanOrEqual(("latitude",), 21.0), LessThanOrEqual(("latitude",), 22.0), EqualTo(("longitude",), -158.5)]))
    return reader


def test_gridded_rows(spark, mirror):
    got = grid(spark, mirror)
    assert got.count() == mirror[1].count() and got.rdd.getNumPartitions() == 4
    keep = "time >= timestamp'2026-02-10 00:00:00' and time < timestamp'2026-02-12 00:00:00' and latitude between 21 and 22.1 and longitude > -158 and longitude <= -157 and sst % 2 = 0"
    assert sorted(map(tuple, got.where(keep).collect())) == sorted(map(tuple, mirror[1].where(keep).collect())) != []


def test_a_box_reads_only_its_slices(spark, mirror):
    part = grid(spark, mirror).where("time >= timestamp'2026-02-10 00:00:00' and time <= timestamp'2026-02-20 00:00:00' and latitude >= 21.0 and latitude <= 22.0 and longitude = -158.5")
    assert part.rdd.getNumPartitions() == 1
    assert part.count() == 10 * 5
    (request,) = [p.request for p in pushed(mirror).partitions()]
    assert sum(b.num_rows for b in G.mirrored(request)) == 11 * 5  # noon of the tenth to the twentieth, and one column
    none = grid(spark, mirror).where("latitude > 50 and latitude < 40")
    assert none.count() == 0


def test_requests_of_lobes_and_slices():
    kinds = pytest.importorskip("pyspark.sql.datasource")
    options = {"base": "https://e.org/erddap", "dataset": "d", "variable": "v", "start": "2026-01-01", "end": "2026-01-10", "slice_days": "4", "lobes": json.dumps([[170, 0, 180, 10], [-180, 0, -170, 10]])}
    schema = type("S", (), {"names": ["time", "latitude", "longitude", "v"]})
    reader = G.GriddedReader(options, schema)
    assert len(reader.requests()) == 6
    list(reader.pushFilters([kinds.GreaterThanOrEqual(("latitude",), 3.5), kinds.LessThan(("longitude",), 175.0), kinds.GreaterThan(("longitude",), 100.0), kinds.EqualTo(("time",), G._instant("2026-01-06"))]))
    (one,) = reader.requests()
    assert one.url() == "https://e.org/erddap/griddap/d.parquet?v%5B(2026-01-06T00:00:00Z):1:(2026-01-06T00:00:00Z)%5D%5B(10.0):1:(3.5)%5D%5B(170.0):1:(175.0)%5D"
    turned = G.GriddedReader(options | {"frame": "360"}, schema).requests()
    assert {r.lon for r in turned} == {(170, 180), (180, 190)}
