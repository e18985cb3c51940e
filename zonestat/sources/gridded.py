"""A gridded dataset as a data source: ranges of time, latitude and longitude become requests.

``spark.read.format("gridded")`` has as its table the dataset's time, latitude, longitude (depth, where asked for) and one
variable. Filters on the axes narrow the requests; each lobe's box and slice of days is one request and one partition. With a
base of http(s) a request is fetched; with any other base its files are a mirror, ``<base>/griddap/<dataset>.parquet`` (a file
or a folder), and the same request reads the row groups that its ranges touch. A server rounds to the nearest steps of its axes,
so rows are held against the exact filters again where they arrive.

Options: base, dataset, variable, start and end (days; the dataset's own extent), slice_days, lat_descending, depth, frame (0 for
longitudes from -180 to 180, 360 for those from 0 to 360), lobes (boxes as JSON, west, south, east, north: one request for each).
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .requests import GridRequest

FORMAT = "gridded"
#: Filters on axes that a request can hold.
PUSHED = {EqualTo: ("low", "high"), GreaterThan: ("low",), GreaterThanOrEqual: ("low",), LessThan: ("high",), LessThanOrEqual: ("high",)}
AXES = ("time", "latitude", "longitude")


def _instant(value: date | datetime | str) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)


@dataclass(frozen=True)
class Range:
    low: float | datetime
    high: float | datetime

    def narrowed(self, ends: tuple[str, ...], value: float | datetime) -> Range:
        low, high = (max(self.low, value) if "low" in ends else self.low), (min(self.high, value) if "high" in ends else self.high)
        return Range(low, high)

    @property
    def empty(self) -> bool:
        return self.low > self.high


class Slice(InputPartition):
    """One request."""

    def __init__(self, request: GridRequest) -> None:
        super().__init__(request.url())
        self.request = request


class GriddedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.base, self.dataset, self.variable = options["base"], options["dataset"], options["variable"]
        self.days = int(options.get("slice_days", 90))
        self.descending = options.get("lat_descending", "true").lower() == "true"
        self.depth = float(options["depth"]) if "depth" in options else None
        self.frame = int(options.get("frame", 0))
        self.lobes = json.loads(options["lobes"]) if "lobes" in options else [[-180.0 if self.frame == 0 else 0.0, -90.0, 180.0 if self.frame == 0 else 360.0, 90.0]]
        self.names = schema.names
        end = _instant(options["end"])
        self.ranges = {"time": Range(_instant(options["start"]), end.replace(hour=23, minute=59, second=59, microsecond=999999) if len(options["end"]) <= 10 else end), "latitude": Range(-90.0, 90.0), "longitude": Range(-math.inf, math.inf)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Ranges of axes narrow the requests; Spark holds rows against every filter again, as servers round to their own steps."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in PUSHED and name in AXES and f.value is not None:
                self.ranges[name] = self.ranges[name].narrowed(PUSHED[type(f)], _instant(f.value) if name == "time" else float(f.value))
            yield f

    def requests(self) -> list[GridRequest]:
        """One for each lobe that the pushed box touches, and each slice of the pushed days."""
        time, lat, lon = (self.ranges[a] for a in AXES)
        if time.empty or lat.empty or lon.empty:
            return []
        spans, first = [], time.low
        while first <= time.high:
            last = min(time.high, first + timedelta(days=self.days) - timedelta(microseconds=1))
            spans.append((first, last))
            first = last + timedelta(microseconds=1)
        stamp = lambda t: t.isoformat().replace("+00:00", "Z")
        out = []
        for west, south, east, north in (map(float, box) for box in self.lobes):
            if self.frame == 360 and west < 0:
                west, east = west + 360, (east + 360 if east <= 0 else east)
            box = Range(max(west, lon.low), min(east, lon.high)), Range(max(south, lat.low), min(north, lat.high))
            if not any(r.empty for r in box):
                out += [
                    GridRequest(self.base, self.dataset, self.variable, (stamp(a), stamp(b)), (box[1].low, box[1].high), (box[0].low, box[0].high), self.descending, self.depth)
                    for a, b in spans
                ]
        return out

    def partitions(self) -> Sequence[InputPartition]:
        return [Slice(r) for r in self.requests()]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Slice):
            return
        source = fetched(partition.request) if partition.request.base.startswith("http") else mirrored(partition.request)
        for batch in source:
            yield _shaped(batch, self.names)


def _shaped(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """The table's columns in order: instants in microseconds, UTC."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    at = names.index("time")
    if pa.types.is_timestamp(columns[at].type):
        columns[at] = columns[at].cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
    numbers = [c if k == at else c.cast(pa.float64()) for k, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(numbers, names=names)


def mirrored(request: GridRequest) -> Iterator[pa.RecordBatch]:
    """A request to a mirror's files: row groups outside of its ranges are skipped."""
    import pyarrow.dataset as ds

    from .places import filesystem

    files, root = filesystem(request.base.rstrip("/"))
    rows = ds.dataset(f"{root}/griddap/{request.dataset}.parquet", filesystem=files, format="parquet")
    kind = rows.schema.field("time").type
    instant = lambda t: pa.scalar(_instant(t) if kind.tz else _instant(t).replace(tzinfo=None), kind)
    first, last = request.time
    keep = (ds.field("time") >= instant(first)) & (ds.field("time") <= instant(last))
    for axis, (low, high) in (("latitude", sorted(request.lat)), ("longitude", sorted(request.lon))):
        keep &= (ds.field(axis) >= low) & (ds.field(axis) <= high)
    if request.depth is not None and "depth" in rows.schema.names:
        keep &= ds.field("depth") == request.depth
    names = [n for n in ("time", "depth", "latitude", "longitude", request.variable) if n in rows.schema.names]
    yield from rows.to_batches(columns=names, filter=keep)


def fetched(request: GridRequest) -> Iterator[pa.RecordBatch]:
    """A request to a server, as Parquet. A step that the server rounded to from outside of the slice is another slice's."""
    from urllib.request import urlopen

    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    with urlopen(replace(request, format="parquet").url()) as answer:
        held = io.BytesIO(answer.read())
    first, last = (pa.scalar(_instant(t), pa.timestamp("us", "UTC")) for t in request.time)
    for batch in pq.ParquetFile(held).iter_batches():
        time = batch.column("time").cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
        yield batch.filter(pc.and_(pc.greater_equal(time, first), pc.less_equal(time, last)))


class Gridded(DataSource):
    """``spark.read.format("gridded")``; see the module's text for its options."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        depth = "depth double, " if "depth" in self.options else ""
        return f"time timestamp, {depth}latitude double, longitude double, `{self.options['variable']}` double"

    def reader(self, schema: StructType) -> GriddedReader:
        return GriddedReader(dict(self.options), schema)


def read_gridded(spark, **options: str):
    """A dataset's rows; filters on time, latitude and longitude become requests."""
    spark.dataSource.register(Gridded)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load()
