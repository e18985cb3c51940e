"""Tables of several formats as DataFrames, with declared or stripped schemas and NaN as null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import spacing_days, step_label
from ..schemas import MASK


def slabs(spark: SparkSession, *paths: str) -> DataFrame:
    """Slab files of a place's lobes as one table, with the file of each row."""
    return spark.read.parquet(*paths).select("*", F.col("_metadata.file_name").alias("file_name"))


def row_count(spark: SparkSession, path: str) -> int:
    """The rows of a written table, from its files' footers."""
    return spark.read.parquet(path).count()


def mask_csv(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """A mask's cells; ``keyed``, those of many places, whose place_id is the files' first column."""
    return spark.read.schema(f"place_id string, {MASK}" if keyed else MASK).option("header", True).csv(path)


def csv_with_units(spark: SparkSession, path: str, numeric: tuple[str, ...] = ()) -> DataFrame:
    """A CSV whose header carries units, 'name (unit)': names without them; named columns as numbers, blanks and NaN as null."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    import re

    rows = rows.toDF(*[re.sub(r"\s*\(.*\)$", "", c) for c in rows.columns])
    number = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(None).cast("double"))
    return rows.withColumns({c: number(c) for c in numeric})


def json_table(documents: DataFrame, column: str, columns: list[str]) -> DataFrame:
    """Rows of documents {"table": {"columnNames": [...], "rows": [[...]]}} as string columns."""
    parsed = F.from_json(column, "table struct<columnNames: array<string>, rows: array<array<string>>>")
    rows = documents.select(parsed["table"].alias("t")).select(F.col("t.columnNames").alias("names"), F.explode("t.rows").alias("row"))
    cell = F.map_from_arrays("names", "row")
    return rows.select(*[cell[c].alias(c) for c in columns])


def info_extent(info: DataFrame, axis: str = "time", by: str = "dataset_id") -> DataFrame:
    """Time extents from attribute rows (dataset_id, row_type, variable, attribute, value).

    The axis's actual_range (seconds) or the coverage attributes; the step from averageSpacing; nValues.
    """
    row = F.col("row_type"), F.col("variable"), F.col("attribute")
    attribute = lambda kind, name, key: F.max(F.when((row[0] == kind) & (row[1] == name) & (row[2] == key), F.col("value")))
    got = info.groupBy(by).agg(
        attribute("attribute", axis, "actual_range").alias("range"), attribute("attribute", "NC_GLOBAL", "time_coverage_start").alias("cover_start"), attribute("attribute", "NC_GLOBAL", "time_coverage_end").alias("cover_end"),
        F.max(F.when((row[0] == "dimension") & (row[1] == axis), F.col("value"))).alias("dimension"),
    )
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ends = F.split("range", ",")
    end_of = lambda k: F.timestamp_seconds(F.trim(F.get(ends, F.lit(k))).try_cast("double"))
    got = got.withColumns({"first": end_of(0), "last": end_of(1), "spacing": F.regexp_extract("dimension", "averageSpacing=([^,]*)", 1)})
    got = got.withColumn("step_days", spacing_days(F.col("spacing")))
    count = F.regexp_extract("dimension", "nValues=([0-9]+)", 1).try_cast("long")
    return got.select(
        by, F.coalesce(iso(F.col("first")), "cover_start").alias("start"), F.coalesce(iso(F.col("last")), "cover_end").alias("end"), "step_days",
        step_label(F.col("step_days")).alias("step_label"), count.alias("n_values"),
    )


def registry(collections: DataFrame) -> DataFrame:
    """Catalog documents (column ``body``, JSON) as datasets: id, dataset_id, base, protocol, lon_range, variables, pending."""
    kind = (
        "id string, `erddap:dataset_id` string, `erddap:base` string, `erddap:protocol` string, `erddap:lon_range` array<double>, `erddap:pending` boolean, "
        "`cube:variables` map<string, struct<unit: string, description: string>>"
    )
    c = collections.select(F.from_json("body", kind).alias("c")).where(F.col("c.id").isNotNull())
    return c.select(
        "c.id", F.col("c.`erddap:dataset_id`").alias("dataset_id"), F.col("c.`erddap:base`").alias("base"), F.coalesce("c.`erddap:protocol`", F.lit("griddap")).alias("protocol"),
        F.col("c.`erddap:lon_range`").alias("lon_range"), F.col("c.`cube:variables`").alias("variables"), F.coalesce("c.`erddap:pending`", F.lit(False)).alias("pending"),
    )
