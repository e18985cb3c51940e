"""Exact dedup through counting quotient filters.

Every partition builds a counting quotient filter (CQF) of its fingerprints. A fingerprint's high
bits are its block, the next bits its quotient, the rest its remainder; all 64 bits are kept. A filter
is its bitmap of occupied quotients, the lengths of their runs, the sorted remainders and counters; that
is what is shuffled, and filters of one block merge losslessly, run by run. Fingerprints counted more
than once route their texts to byte verification (grouping by the bytes themselves); a bitmap of them,
of fixed size, is broadcast, so that other texts aren't shuffled.

Nulls: a null text equals the empty text. Equal rows: the row with the largest doc_id stays; rows
that repeat a doc_id and its text share that outcome. A null doc_id stays only if all its copies'
ids are null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flagged, lower_ascii

#: Fingerprints that one block should hold, about; sets the number of blocks.
BLOCK_FINGERPRINTS = 1 << 15
QUOTIENT_BITS = 16
#: Parts that the copies of one text are dealt into before they are pre-aggregated by their bytes.
SALTS = 8


class CountingQuotientFilter:
    """A CQF over the low ``bits`` bits of fingerprints: runs of sorted remainders by quotient, with counters.

    ``occupied`` has one bit for each quotient, ``lengths`` the length of each occupied quotient's run.
    """

    def __init__(self, bits: int, occupied: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.q = bits, min(QUOTIENT_BITS, bits)
        self.occupied, self.lengths, self.remainders, self.counts = occupied, lengths, remainders, counts

    @classmethod
    def _of_runs(cls, bits: int, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From sorted pairs of quotient and remainder."""
        used, lengths = np.unique(quotients, return_counts=True)
        occupied = np.zeros(1 << min(QUOTIENT_BITS, bits), np.uint8)
        occupied[used] = 1
        return cls(bits, np.packbits(occupied), lengths, remainders, counts)

    @classmethod
    def of(cls, bits: int, fingerprints: np.ndarray) -> CountingQuotientFilter:
        keys, counts = np.unique(fingerprints & np.uint64((1 << bits) - 1), return_counts=True)
        rest = np.uint64(bits - min(QUOTIENT_BITS, bits))
        return cls._of_runs(bits, (keys >> rest).astype(np.int64), keys & ((np.uint64(1) << rest) - np.uint64(1)), counts.astype(np.int64))

    def quotients(self) -> np.ndarray:
        """The quotient of each remainder."""
        return np.repeat(np.flatnonzero(np.unpackbits(self.occupied)), self.lengths)

    def keys(self) -> np.ndarray:
        return self.quotients().astype(np.uint64) << np.uint64(self.bits - self.q) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Runs of one quotient become one run; equal remainders of it add their counters."""
        quotients = np.concatenate([self.quotients(), other.quotients()])
        remainders, counts = np.concatenate([self.remainders, other.remainders]), np.concatenate([self.counts, other.counts])
        order = np.lexsort((remainders, quotients))
        quotients, remainders, counts = quotients[order], remainders[order], counts[order]
        first = np.flatnonzero(np.r_[True, (quotients[1:] != quotients[:-1]) | (remainders[1:] != remainders[:-1])][: len(order)])
        return CountingQuotientFilter._of_runs(self.bits, quotients[first], remainders[first], np.add.reduceat(counts, first) if len(first) else counts)

    @property
    def width(self) -> int:
        """Bytes of a remainder."""
        return max(1, -(-(self.bits - self.q) // 8))

    def to_row(self) -> tuple[bytes, bytes, bytes, bytes]:
        """occupied, lengths, remainders, counts; counters of 1 take almost nothing."""
        flat = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        pack = lambda x: zlib.compress(x.astype("<i8").tobytes(), 1)
        return zlib.compress(self.occupied.tobytes(), 1), pack(self.lengths), flat.tobytes(), pack(self.counts)

    @classmethod
    def from_row(cls, bits: int, occupied: bytes, lengths: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        unpack = lambda x: np.frombuffer(zlib.decompress(x), "<i8")
        made = cls(bits, np.frombuffer(zlib.decompress(occupied), np.uint8), unpack(lengths), np.zeros(0, np.uint64), unpack(counts))
        wide = np.zeros((len(made.counts), 8), np.uint8)
        wide[:, : made.width] = np.frombuffer(remainders, np.uint8).reshape(-1, made.width)
        made.remainders = wide.view("<u8").ravel()
        return made


def _build(block_bits: int):
    bits = 64 - block_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b["fp"].to_numpy(np.int64) for b in batches]
        if not held:
            return
        fp = np.sort(np.concatenate(held).view(np.uint64))
        block = (fp >> np.uint64(bits)).astype(np.int64) if block_bits else np.zeros(len(fp), np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(fp) else []
        rows = []
        for part, b in zip(np.split(fp, starts[1:]), block[starts], strict=True) if len(fp) else ():
            rows.append((int(b), *CountingQuotientFilter.of(bits, part).to_row()))
        yield pd.DataFrame(rows, columns=["block", "occupied", "lengths", "remainders", "counts"])

    return build


def _merge(block_bits: int):
    bits = 64 - block_bits

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        filters = [CountingQuotientFilter.from_row(bits, *row) for row in pdf[["occupied", "lengths", "remainders", "counts"]].itertuples(index=False)]
        while len(filters) > 1:  # pairwise: each remainder is moved log2(filters) times
            filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2])] + filters[len(filters) // 2 * 2 :]
        twice = filters[0].counts > 1
        keys = filters[0].keys()[twice]
        if block_bits:
            keys |= np.uint64(int(pdf["block"].iloc[0])) << np.uint64(bits)
        return pd.DataFrame({"fp": keys.view(np.int64), "copies": filters[0].counts[twice]})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (column fp) that occur more than once, with their exact counts (fp, copies)."""
    block_bits = max(0, math.ceil(math.log2(max(1, rows / BLOCK_FINGERPRINTS))))
    built = fingerprints.mapInPandas(_build(block_bits), "block long, occupied binary, lengths binary, remainders binary, counts binary")
    return built.groupBy("block").applyInPandas(_merge(block_bits), "fp long, copies long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.col(text_col)).alias("norm"))
    norm = norm.withColumn("fp", F.xxhash64("norm"))
    repeated = cut(repeated_fingerprints(norm.select("fp"), docs.count()))
    routed = flagged(norm, F.col("fp"), repeated.select("fp"), "again").where("again").drop("again")
    # byte verification: grouping compares the texts themselves, partial aggregation absorbs hot copies
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    salted = repeated.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    classes = (
        routed.select("*", salt).join(salted, ["fp", "salt"], "left_semi").groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"))
    out = rows.join(classes, "text_sha256", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )
