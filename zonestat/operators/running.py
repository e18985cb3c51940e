"""Running totals over one global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..tables import written


def _within(sums: list[str], xors: list[str]):
    """Totals within one range partition, its rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, held = TaskContext.get().partitionId(), 0, dict.fromkeys(sums + xors, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns, names = list(batch.columns), list(batch.schema.names)
            new = {"running_part": np.full(n, part, np.int64), "running_row": np.arange(row + 1, row + n + 1)}
            for name in sums + xors:
                values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                values[0] = values[0] + held[name] if name in sums else values[0] ^ held[name]
                total = np.cumsum(values) if name in sums else np.bitwise_xor.accumulate(values)
                held[name] = int(total[-1])
                new[f"running_{name}"] = total
            row += n
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v) for v in new.values()], names=names + list(new))

    return run


def running(df: DataFrame, by: list[str], sums: list[str] = (), xors: list[str] = ()) -> DataFrame:
    """``df`` with running_row (from 1) and running_<name>: totals of ``sums`` and exclusive-or of ``xors``, own row included.

    Rows are put in the order of ``by`` by range partitions; a key that many rows have is split by what comes after it
    in ``by``. Each partition is read once as a stream. What the partitions before it add up to, one row a partition, is
    broadcast. The result is written once, so ties keep the order they got.
    """
    sums, xors = list(sums), list(xors)
    schema = StructType([*df.schema.fields, *[StructField(f"running_{c}", LongType()) for c in ("part", "row", *sums, *xors)]])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = written(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_within(sums, xors), schema))
    last = F.max(F.struct("running_row", *[f"running_{c}" for c in sums + xors])).alias("t")
    ends = local.groupBy("running_part").agg(last).select("running_part", "t.*")
    before = Window.orderBy("running_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition

    def earlier(name: str) -> Column:
        column = F.col(f"running_{name}")
        total = F.bit_xor(column) if name in xors else F.sum(column)
        return F.coalesce(total.over(before), F.lit(0)).alias(f"before_{name}")

    names = ["row", *sums, *xors]
    offsets = ends.select("running_part", *[earlier(n) for n in names])
    both = local.join(F.broadcast(offsets), "running_part")
    whole = lambda n: F.col(f"running_{n}").bitwiseXOR(F.col(f"before_{n}")) if n in xors else F.col(f"running_{n}") + F.col(f"before_{n}")
    return both.select(*df.columns, *[whole(n).alias(f"running_{n}") for n in names])
