"""Sinks: series as Parquet, one-file exports, CSV, line-delimited features, GeoParquet footers, catalog documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_series(series: DataFrame, path: str, by: tuple[str, ...] = ("dataset_id", "variable", "place_id")) -> None:
    """A materialised series, partitioned by what queries ask for; the committer makes it appear whole."""
    held = series.repartition(*by) if by else series
    held.sortWithinPartitions(*by, "date").write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def export_parquet(result: DataFrame, path: str) -> None:
    """A small result (a series or a map) as one file."""
    result.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def export_csv(result: DataFrame, path: str) -> None:
    result.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("dateFormat", "yyyy-MM-dd").csv(path)


def features(rows: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """Rows as GeoJSON features, one line each; geometry is a struct with type and coordinates."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def _framed(cells: DataFrame, centre: int | None) -> DataFrame:
    """Cells with longitudes in the frame in which they don't wrap, and missing values as null."""
    from ..functions.columns import no_nan, normal_longitude
    from ..operators.choices import frame_choice

    if centre is None:
        one = frame_choice(cells.withColumn("all_", F.lit(0)), "all_").select(F.col("centre").alias("frame_"))  # one row
        framed = cells.crossJoin(F.broadcast(one))
        lon = F.when(F.col("frame_") == 180, normal_longitude(F.col("longitude"), 180)).otherwise(normal_longitude(F.col("longitude"), 0))
        framed = framed.withColumn("longitude", lon).drop("frame_")
    else:
        framed = cells.withColumn("longitude", normal_longitude(F.col("longitude"), centre))
    value = {"value": F.when(F.abs(no_nan(F.col("value"))) < float("inf"), F.col("value"))} if "value" in cells.columns else {}
    return framed.withColumns(value)


def cell_squares(cells: DataFrame, dx: float | None = None, dy: float | None = None, centre: int | None = 0) -> DataFrame:
    """Cells as squares about their centres, latitudes kept within the poles, values kept where null.

    Steps that aren't given are measured; an axis with one value takes the other's. ``centre`` None picks the frame that doesn't wrap.
    """
    from ..operators.choices import spacings

    cells = _framed(cells, centre)
    if dx is None or dy is None:
        steps = spacings(cells).select((F.lit(dx) if dx is not None else F.col("dx")).alias("dx_"), (F.lit(dy) if dy is not None else F.col("dy")).alias("dy_"))  # one row
    else:
        steps = cells.sparkSession.range(1).select(F.lit(float(dx)).alias("dx_"), F.lit(float(dy)).alias("dy_"))
    cells = cells.crossJoin(F.broadcast(steps))
    west, east = F.col("longitude") - F.col("dx_") / 2, F.col("longitude") + F.col("dx_") / 2
    south, north = F.greatest(F.lit(-90.0), F.col("latitude") - F.col("dy_") / 2), F.least(F.lit(90.0), F.col("latitude") + F.col("dy_") / 2)
    ring = F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south))
    return cells.withColumn("geometry", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).drop("dx_", "dy_")


def cell_points(cells: DataFrame, centre: int | None = None) -> DataFrame:
    """Sample positions as points, in the frame in which they don't wrap."""
    framed = _framed(cells, centre)
    return framed.withColumn("geometry", F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")))


def geoparquet_footer(geometry: str, box: tuple[float, float, float, float], kinds: list[str]) -> dict[str, str]:
    """The ``geo`` entry of a GeoParquet 1.1 footer, for a WKB column and its box column."""
    corners = {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}
    column = {"encoding": "WKB", "geometry_types": sorted(kinds), "bbox": list(box), "covering": {"bbox": corners}}
    return {"geo": json.dumps({"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}})}


def items(manifest: DataFrame) -> DataFrame:
    """STAC items of materialised series (id, place_id, dataset_id, variable, start, end, west, south, east, north, href) as JSON."""
    instant = lambda c: F.concat(F.col(c).cast("string"), F.lit("T00:00:00Z"))
    body = F.struct(
        F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), "id", F.array("west", "south", "east", "north").alias("bbox"),
        F.struct(instant("start").alias("start_datetime"), instant("end").alias("end_datetime"), "place_id", "dataset_id", "variable").alias("properties"),
        F.struct(F.struct("href", F.lit("application/vnd.apache.parquet").alias("type")).alias("series")).alias("assets"),
    )
    return manifest.select("id", F.to_json(body).alias("body"))


def collections(manifest: DataFrame, planned: DataFrame, by: str = "collection") -> DataFrame:
    """STAC collections of materialised series, and their item links: by collection, ``body`` (JSON) and ``links`` (as a table, see ``item_links``).

    ``manifest`` as in ``items`` with status (complete or partial); ``planned`` has the collection and ids of all targets: those without
    an item are pending. The extent goes round the globe as its boxes do.
    """
    from ..operators.mask import union_bbox

    instant = lambda c: F.concat(F.col(c).cast("string"), F.lit("T00:00:00Z"))
    sorted_ = lambda c: F.array_sort(F.collect_set(c))
    box = union_bbox(manifest, by)
    rolled = manifest.groupBy(by).agg(
        F.min("start").alias("first"), F.max("end").alias("last"), sorted_("dataset_id").alias("datasets"), sorted_("variable").alias("variables"), sorted_("place_id").alias("places"), sorted_("status").alias("states"),
        F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "partial").alias("partial"),
    )
    waiting = planned.join(manifest.select("id"), "id", "left_anti").dropDuplicates(["id"]).groupBy(by).agg(F.count("*").alias("pending"))
    rows = rolled.join(box, by).join(waiting, by, "left")
    body = F.struct(
        F.lit("Collection").alias("type"), F.col(by).alias("id"), F.lit("1.0.0").alias("stac_version"),
        F.struct(F.struct(F.array(F.array("west", "south", "east", "north")).alias("bbox")).alias("spatial"), F.struct(F.array(F.array(instant("first"), instant("last"))).alias("interval")).alias("temporal")).alias("extent"),
        F.struct(F.col("datasets").alias("dataset_id"), F.col("variables").alias("variable"), F.col("places").alias("place_id"), F.col("states").alias("status")).alias("summaries"),
        F.struct("complete", "partial", F.coalesce("pending", F.lit(0)).alias("pending")).alias("item_counts"),
    )
    return rows.select(by, F.to_json(body).alias("body"))


def item_links(manifest: DataFrame, by: str = "collection") -> DataFrame:
    """A collection's links to its items, one row each: links grow with items, so they are a table beside the document."""
    return manifest.select(by, "id", F.lit("item").alias("rel"), F.concat(F.lit("./items/"), "id", F.lit(".json")).alias("href"), F.concat("place_id", F.lit(", "), "variable").alias("title"), "status")
