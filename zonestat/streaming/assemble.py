"""A series kept up to date as its chunks land, in any order: late and re-snapped rows settle as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import oldest_rows
from ..tables import written


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunk files (with span_start and span_end) as they land."""
    return spark.readStream.schema(schema).parquet(path)


def stream_assemble(chunks: DataFrame, keys: tuple[str, ...] = ("date",), by: tuple[str, ...] = ()) -> DataFrame:
    """The row of each key from the oldest chunk whose span holds it.

    Rows outside their chunk's span are dropped. State is one row for each key, that is the series itself; an older chunk that
    arrives late takes its days back, so the end state is that of ``incremental.assemble`` under any order of arrival.
    """
    return oldest_rows(chunks, keys, by)


def upsert(batch: DataFrame, path: str, keys: tuple[str, ...], parts: tuple[str, ...]) -> None:
    """Puts rows into a table partitioned by ``parts``: rows of the same keys are replaced, other partitions aren't touched."""
    spark = batch.sparkSession
    rows = batch.select("*")
    try:
        held = spark.read.schema(batch.schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = None
    if held is not None:
        touched = held.join(batch.select(*parts).distinct(), list(parts), "left_semi") if parts else held
        rows = batch.unionByName(touched.join(batch.select(*parts, *keys), [*parts, *keys], "left_anti"))
    whole = written(rows)  # a table can't be replaced while it is read
    dealt = whole.repartition(*parts) if parts else whole.coalesce(1)
    writer = dealt.sortWithinPartitions(*parts, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def write_assembled(chunks: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("date",), by: tuple[str, ...] = ("place_id",)) -> StreamingQuery:
    """Runs until all that has landed is in the series at ``path``; changed rows alone are written. A batch that runs again writes the same rows."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(batch, path, keys, by)

    stream = stream_assemble(chunks, keys, by).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return stream.foreachBatch(put).trigger(availableNow=True).start()
