"""Well-known binary in columns: whole Arrow batches to rings, edges, boxes and parts, and back.

A ring's points are read as one array; Python steps once for each ring, never for each point. Fixed values of the
format: geometry types 1 to 7, byte order 1 little and 0 big, flags 0x80000000 z, 0x40000000 m, 0x20000000 SRID,
thousands 1 z, 2 m, 3 both.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

#: Parts of a place, their rings, their points.
PARTS = ArrayType(ArrayType(ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType()))))
BOX = StructType([StructField(c, DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")])
_EDGE = StructType([*[StructField(c, IntegerType()) for c in ("part", "ring", "k")], *[StructField(c, DoubleType()) for c in ("ax", "ay", "bx", "by")], StructField("reason", StringType())])
#: Collections inside collections, at most.
DEEPEST = 32
#: Edges of an Arrow batch, about.
EDGES_AT_ONCE = 200_000

Ring = tuple[int, int, np.ndarray]


class Malformed(ValueError):
    """A value that isn't WKB of types 1 to 7."""


def _walk(data: memoryview, at: int, end: int, first: int, out: list[Ring], depth: int = 0) -> tuple[int, int]:
    """Adds a geometry's rings (part, ring, points) to ``out``; returns where it ends and the next part's number."""
    if at + 5 > end:
        raise Malformed("the value ends early")
    if depth > DEEPEST:
        raise Malformed("collections are nested too deep")
    if data[at] not in (0, 1):
        raise Malformed(f"unknown byte order {data[at]}")
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5 + 4 * bool(code & 0x20000000)
    thousands, kind = divmod(code & 0x0FFFFFFF, 1000)
    width = 2 + bool(code & 0x80000000 or thousands in (1, 3)) + bool(code & 0x40000000 or thousands in (2, 3))
    if kind not in range(1, 8) or thousands > 3:
        raise Malformed(f"unknown geometry type {code & 0x0FFFFFFF}")

    def counted(at: int) -> tuple[int, int]:
        if at + 4 > end:
            raise Malformed("the value ends early")
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == 1:
        n = 1
    else:
        n, at = counted(at)
    if kind in (1, 2):
        at += 8 * width * n
    elif kind == 3:
        for ring in range(n):
            points, at = counted(at)
            if at + 8 * width * points > end:
                raise Malformed("the value ends early")
            xy = np.frombuffer(data, order + "f8", points * width, at).reshape(points, width)[:, :2]
            out.append((first, ring, xy.astype(np.float64)))
            at += 8 * width * points
        first += n > 0
    else:
        for _ in range(n):
            at, first = _walk(data, at, end, first, out, depth + 1)
    if at > end:
        raise Malformed("the value ends early")
    return at, first


def rings_of(column: pa.Array) -> tuple[list[list[Ring]], list[str | None]]:
    """By value: its polygons' rings, and why it has none where it is malformed. Null values have none and no reason."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    found: list[list[Ring]] = []
    reasons: list[str | None] = []
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else []
    data = memoryview(column.buffers()[2] or b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        rings: list[Ring] = []
        reason = None
        if valid[k]:
            try:
                _walk(data, int(offsets[k]), int(offsets[k + 1]), 0, rings)
            except Malformed as e:
                rings, reason = [], str(e)
        found.append(rings)
        reasons.append(reason)
    return found, reasons


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, reasons = rings_of(batch.column(1))
        held: list[tuple[int, Ring | None]] = []
        size = 0
        for row, rings in enumerate(found):
            held += [(row, r) for r in rings] or ([(row, None)] if reasons[row] else [])
            size += sum(len(r[2]) for r in rings)
            if size >= EDGES_AT_ONCE:
                yield _edges(batch, reasons, held)
                held, size = [], 0
        yield _edges(batch, reasons, held)


def _edges(batch: pa.RecordBatch, reasons: list[str | None], held: list[tuple[int, Ring | None]]) -> pa.RecordBatch:
    """Edge rows of rings; a malformed value has one row without an edge."""
    bad = [row for row, ring in held if ring is None]
    rings = [(row, r) for row, r in held if r is not None and len(r[2]) > 1]
    n = np.array([len(r[2]) - 1 for _, r in rings], np.int64)
    of = np.repeat(np.arange(len(rings)), n)
    a = np.concatenate([r[2][:-1] for _, r in rings]) if rings else np.zeros((0, 2))
    b = np.concatenate([r[2][1:] for _, r in rings]) if rings else np.zeros((0, 2))
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = lambda values: np.array(values, np.int32)[of] if rings else np.zeros(0, np.int32)
    row = np.concatenate([at([row for row, _ in rings]), np.array(bad, np.int32)])
    padded = lambda v, kind: pa.concat_arrays([pa.array(v, kind), pa.nulls(len(bad), kind)])
    columns = [
        batch.column(0).take(pa.array(row)), padded(at([r[0] for _, r in rings]), pa.int32()), padded(at([r[1] for _, r in rings]), pa.int32()), padded(k.astype(np.int32), pa.int32()),
        *[padded(np.ascontiguousarray(v), pa.float64()) for v in (a[:, 0], a[:, 1], b[:, 0], b[:, 1])],
        pa.concat_arrays([pa.nulls(len(of), pa.string()), pa.array([reasons[r] for r in bad], pa.string())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["place_id", "part", "ring", "k", "ax", "ay", "bx", "by", "reason"])


def wkb_edges(places: DataFrame, key: str = "place_id", geometry: str = "geometry") -> DataFrame:
    """Edge rows of WKB or EWKB values: place_id, part, ring, k, ax, ay, bx, by, reason.

    A malformed value gives one row with its reason and no edge; edges have a null reason. Null values, points and lines give none.
    """
    schema = StructType([StructField("place_id", places.schema[key].dataType), *_EDGE.fields])
    return places.select(F.col(key).alias("place_id"), F.col(geometry).alias("geometry")).mapInArrow(_edge_batches, schema)


def _nested(found: list[list[Ring]], missing: np.ndarray) -> pa.Array:
    """Values' rings as lists of parts of rings of points; null where ``missing``."""
    parts, rings, points, xy = [0], [0], [0], []
    for value in found:
        last = None
        for part, _, ring in value:
            if part != last:
                rings.append(rings[-1])
                last = part
            rings[-1] += 1
            points.append(points[-1] + len(ring))
            xy.append(ring)
        parts.append(len(rings) - 1)
    flat = np.concatenate(xy) if xy else np.zeros((0, 2))
    point = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in (0, 1)], names=["x", "y"])
    offsets = lambda v: pa.array(np.array(v, np.int32))
    inner = pa.ListArray.from_arrays(offsets(rings), pa.ListArray.from_arrays(offsets(points), point))
    return pa.ListArray.from_arrays(offsets(parts), inner, mask=pa.array(missing))


@F.arrow_udf(PARTS)
def wkb_parts(geometry: pa.Array) -> pa.Array:
    """Polygons of WKB or EWKB values as an array of parts, rings and points (x, y); null for null and malformed values."""
    found, reasons = rings_of(geometry)
    return _nested(found, np.array([r is not None for r in reasons], bool) | ~geometry.is_valid().to_numpy(zero_copy_only=False))


@F.arrow_udf(BOX)
def wkb_box(geometry: pa.Array) -> pa.Array:
    """The least and largest coordinates of WKB polygons; null where there are none."""
    found, _ = rings_of(geometry)
    some = np.array([any(len(r[2]) for r in rings) for rings in found], bool)
    box = np.array([np.r_[np.concatenate([r[2] for r in rings]).min(axis=0), np.concatenate([r[2] for r in rings]).max(axis=0)] if ok else np.zeros(4) for rings, ok in zip(found, some, strict=True)]).reshape(-1, 4)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(box[:, k])) for k in range(4)], names=["xmin", "ymin", "xmax", "ymax"], mask=pa.array(~some))


@F.arrow_udf(BinaryType())
def parts_wkb(parts: pa.Array) -> pa.Array:
    """Parts, rings and points as little-endian WKB MultiPolygons of two dimensions."""
    out = []
    for value in range(len(parts)):
        if not parts.is_valid()[value].as_py():
            out.append(None)
            continue
        rows = parts[value].values
        body = [struct.pack("<BII", 1, 6, len(rows))]
        for part in rows:
            body.append(struct.pack("<BII", 1, 3, len(part.values)))
            for ring in part.values:
                points = ring.values
                xy = np.column_stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)])
                body += [struct.pack("<I", len(xy)), np.ascontiguousarray(xy, "<f8").tobytes()]
        out.append(b"".join(body))
    return pa.array(out, pa.binary())
