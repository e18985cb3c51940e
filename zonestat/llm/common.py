"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session has none (tests) a temporary folder is set and used; on a cluster it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="zonestat-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table of ``df``, which ``cut`` returned, once its readers are done."""
    names = {f.split("/cut-")[1].split("/")[0] for f in df.inputFiles() if "/cut-" in f}
    for item in [w for w in _written if w[1].rsplit("/cut-", 1)[-1] in names]:
        _written.remove(item)
        _remove([item])


def _remove(items: list[tuple[SparkSession, str]] | None = None) -> None:
    for spark, path in _written if items is None else items:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended
            return


atexit.register(_remove)


#: Words of 64 marks: all that ``flagged`` broadcasts, 16 bytes each.
MARK_WORDS = 1 << 18


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flagged(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column ``flag``: false only where ``key`` isn't among the hashes of ``keys`` (its only column).

    Hashes set marks in a bitmap of fixed size, which is broadcast: most rows are told apart without a shuffle, the
    more the fewer keys there are. Rows with the flag are to be joined exactly.
    """
    word = lambda h: F.pmod(F.shiftright(h, 6), F.lit(MARK_WORDS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    at, bits = fresh(df, "mark_word"), fresh(df, "mark_bits")
    (h,) = (F.col(c) for c in keys.columns)
    marks = keys.select(word(h).alias(at), bit(h).alias("bit")).groupBy(at).agg(F.bit_or("bit").alias(bits))
    held = df.withColumn(at, word(key)).join(F.broadcast(marks), at, "left")
    return held.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False))).drop(at, bits)


#: Rows of texts in an Arrow batch; Spark's own default holds ten times as many.
BATCH = 1000


def lean_batches(spark: SparkSession) -> None:
    """For what the session runs from now on: batches of BATCH rows, for executors of little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """While eager steps run, at most so many rows of texts in an Arrow batch: tasks hold few megabytes at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
