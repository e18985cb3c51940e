"""Places as GeoParquet: a sink that Spark commits whole, projected scans, and lookups that skip row groups.

Spark's own Parquet writer can't set a footer's ``geo`` entry, so the sink is a data source: tasks write their files
beside the table under pending names, through pyarrow's filesystems, and the driver's commit gives them their names.
Reading is Spark's Parquet scan: filters on place_id and on the box column reach it and skip row groups by statistics.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.wkb import rings_of
from .writers import geoparquet_footer

FORMAT = "geoparquet"
#: Rows of a row group: a lookup reads one.
GROUP_ROWS = 2000
PLACE = ["place_id", "gazetteer", "name", "area_km2", "bbox", "geometry"]


def circle_box(boxes: np.ndarray) -> list[float] | None:
    """The least box on the circle of longitudes that holds boxes (west, south, east, north); west > east where it crosses 180."""
    boxes = boxes[np.isfinite(boxes).all(axis=1)]
    if not len(boxes):
        return None
    order = boxes[np.argsort(boxes[:, 0], kind="stable")]
    west, reach = order[:, 0], np.maximum.accumulate(order[:, 2])
    gaps = west[1:] - reach[:-1]
    across = west[0] + 360 - reach[-1]
    k = int(gaps.argmax()) if len(gaps) else -1
    low, high = (west[k + 1], reach[k]) if k >= 0 and gaps[k] > across else (west[0], reach[-1])
    return [float(low), float(boxes[:, 1].min()), float(high), float(boxes[:, 3].max())]


@dataclass
class Written(WriterCommitMessage):
    pending: list[str]


def filesystem(path: str) -> tuple:
    """pyarrow's filesystem of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class GeoParquetWriter(DataSourceArrowWriter):
    """Each task's rows as one file of whole row groups; nothing is seen before the commit."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.rows, self.geometry = int(options.get("row_group", GROUP_ROWS)), options.get("geometry", "geometry")
        self.provenance = options.get("provenance")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        pending = f"{root}/_pending-{uuid.uuid4().hex}.parquet"
        held: list[pa.RecordBatch] = []
        boxes: list[np.ndarray] = []
        kinds: set[str] = set()
        writer = None

        def flush(last: bool) -> None:
            nonlocal held
            if not held:  # the rows before filled whole groups
                return
            table = pa.Table.from_batches(held)
            full = len(table) if last else len(table) // self.rows * self.rows
            if full:
                writer.write_table(table.slice(0, full), row_group_size=self.rows)
            held = table.slice(full).to_batches() if full < len(table) else []

        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = pq.ParquetWriter(pending, batch.schema, filesystem=files, compression="zstd")
            geometry = batch.column(batch.schema.get_field_index(self.geometry))
            for rings in rings_of(geometry)[0]:
                kinds |= {"MultiPolygon"} if rings else set()
                shells = [r[2] for r in rings if r[1] == 0 and len(r[2])]
                boxes += [np.r_[s.min(axis=0), s.max(axis=0)] for s in shells]
            if len(boxes) > 100_000:  # a running union: few numbers are held
                boxes = [np.array(box)] if (box := circle_box(np.array(boxes))) and box[0] <= box[2] else boxes
            held.append(batch)
            if sum(b.num_rows for b in held) >= self.rows:
                flush(False)
        if writer is None:
            return Written([])
        flush(True)
        box = circle_box(np.array(boxes).reshape(-1, 4)) or [-180.0, -90.0, 180.0, 90.0]
        footer = geoparquet_footer(self.geometry, tuple(box), sorted(kinds))
        writer.add_key_value_metadata(footer | ({"places:provenance": self.provenance} if self.provenance else {}))
        writer.close()
        return Written([pending])

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-") or f.base_name == "_SUCCESS"] if self.overwrite else []
        for path in old:
            files.delete_file(path)
        batch = uuid.uuid4().hex[:12]
        for k, pending in enumerate(p for m in messages if m for p in m.pending):
            files.move(pending, f"{root}/part-{k:05d}-{batch}.parquet")
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = filesystem(self.path)
        for pending in (p for m in messages if m for p in m.pending):
            files.delete_file(pending)


class GeoParquet(DataSource):
    """The sink ``df.write.format("geoparquet")``: options path, row_group, geometry, provenance."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> GeoParquetWriter:
        return GeoParquetWriter(dict(self.options), overwrite)


def _interleaved(x: Column, y: Column, bits: int = 16) -> Column:
    """A place on the Z-shaped curve through the globe: near boxes get near numbers."""
    scaled = lambda c, low, wide: F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor((c - low) / wide * (1 << bits)))).cast("long")
    u, v = scaled(x, -180.0, 360.0), scaled(y, -90.0, 180.0)
    spread = lambda c: sum((F.shiftleft(F.shiftright(c, k).bitwiseAND(1), 2 * k) for k in range(1, bits)), c.bitwiseAND(1))
    return spread(u) + F.shiftleft(spread(v), 1)


def write_places(places: DataFrame, path: str, order: str = "space", row_group: int = GROUP_ROWS, provenance: dict | None = None, files: int | None = None) -> None:
    """Places (place_id, geometry as WKB, bbox as struct, any others) as GeoParquet 1.1 files.

    ``order`` is what lookups ask for: ``space`` puts near places together, so that a box reads few row groups; ``id`` the ids.
    Each file's footer has the box of its places and ``provenance``. Malformed geometries are refused by their readers, not here.
    """
    spark = places.sparkSession
    spark.dataSource.register(GeoParquet)
    curve = _interleaved((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2)
    by = [F.col("place_id")] if order == "id" else [F.coalesce(curve, F.lit(-1)), F.col("place_id")]
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.repartitionByRange(n, *by).sortWithinPartitions(*by)
    writer = dealt.write.format(FORMAT).mode("overwrite").option("path", path).option("row_group", str(row_group))
    if provenance:
        writer = writer.option("provenance", json.dumps(provenance))
    writer.save()


def scan_places(spark: SparkSession, path: str) -> DataFrame:
    """The six columns of places, by gazetteer and name: only they are read. The authority is the gazetteer of files that have no such column."""
    rows = spark.read.parquet(path)
    have = set(rows.columns)
    gazetteer = next((F.col(c) for c in ("gazetteer", "authority") if c in have), F.substring_index("place_id", ":", 1))
    area = F.col("area_km2").cast("double") if "area_km2" in have else F.lit(None).cast("double")
    named = rows.select("place_id", gazetteer.alias("gazetteer"), F.coalesce("name", "place_id").alias("name"), area.alias("area_km2"), "bbox", "geometry")
    return named.orderBy("gazetteer", "name", "place_id")


def place_by_id(spark: SparkSession, path: str, place_id: str) -> DataFrame:
    """One place: the filter reaches the scan and skips row groups by their statistics."""
    return spark.read.parquet(path).where(F.col("place_id") == place_id)


def places_in_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Places whose boxes touch a box (west > east: across 180): row groups that lie elsewhere aren't read."""
    rows = spark.read.parquet(path)
    x0, x1 = F.col("bbox.xmin"), F.col("bbox.xmax")
    wide = (x1 >= west) & (x0 <= east) if west <= east else (x1 >= west) | (x0 <= east)
    return rows.where(wide & (F.col("bbox.ymax") >= south) & (F.col("bbox.ymin") <= north))
