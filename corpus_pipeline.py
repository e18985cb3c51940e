"""The corpus pipeline: language, exact and near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; it is written as
Parquet and read again. All but the last return the columns of ``documents``. Documents with null ids
pass the two dedup stages; other rows that are equal in all columns count once after exact dedup; a
document's copies in the mix are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonestat.llm.common import cut, flagged, fresh, lean_batches, table
from zonestat.llm.exact_dedup import exact_dedup
from zonestat.llm.language_id import language_id
from zonestat.llm.mixing import mix
from zonestat.llm.near_dedup import near_dedup
from zonestat.llm.piece_codec import encode_decode
from zonestat.llm.queries import piece_model

#: A prediction that is hardly better than chance among a few languages is no language.
LEAST_SCORE = 0.3


def _apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may be among ``ids``, and those that aren't (null ids never are): only the former need a shuffle."""
    flag = fresh(docs, "among")
    told = flagged(docs, F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id").alias("h")), flag)
    told = told.withColumn(flag, F.col(flag) & F.col("doc_id").isNotNull())
    return told.where(F.col(flag)).select(docs.columns), told.where(~F.col(flag)).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    lean_batches(spark)
    known = language_id(docs, keep=True)
    pred, score = known.columns[-2:]
    return known.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).drop(pred, score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document."""
    copies = cut(exact_dedup(docs).where((F.col("group_size") > 1) & F.col("doc_id").isNotNull()).select("doc_id", "kept"))
    some, others = _apart(docs, copies)
    dropped = copies.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept"))
    # rows that repeat an id and a text lie together after the join: this adds no shuffle
    return some.join(dropped, "doc_id", "left_anti").select(docs.columns).distinct().unionByName(others)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, one document."""
    dropped = cut(near_dedup(docs).where(~F.col("kept")).select("doc_id").distinct())
    some, others = _apart(docs, dropped)
    return some.join(dropped, "doc_id", "left_anti").select(docs.columns).unionByName(others)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    of, copies = fresh(docs, "taken_id"), fresh(docs, "taken_copies")
    taken = mix(docs).groupBy(F.col("doc_id").alias(of)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken[of]))
    return rows.withColumn(of, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to, as digests."""
    lean_batches(spark)
    return encode_decode(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
