"""SimHash near-duplicates by ball hashing: fingerprints meet at variants half way between them.

A text's fingerprint sums up the 64-bit hashes of its three-word shingles, repeats included: a bit is set where
over half of the hashes have it. Two fingerprints are linked if they differ in RADIUS = 3 bits or fewer.

Half of that radius is one bit and a half. So first every distinct fingerprint emits its variants within one
bit. The fingerprints that meet at a variant (65 at most, as they are distinct) differ in two bits or fewer:
they need no pairs, each is linked to the least of them. That finds all links of one or two bits, exactly.

A link of three bits meets at a variant that is one bit from one end and two from the other, and its ends
differ in parity: even fingerprints emit their variants of one bit, odd ones those of two bits (2016). All
even ones at a variant are within two bits of each other, so one stands for them, and whatever odd one
comes there lies within three bits of it: again no pairs, and each meeting is a link. Only fingerprints that
may still join two components emit these: those that agree with one of another component in five of eight
bytes, as every link of three bits does. Components come from contraction of the graph, in DataFrame joins.

Null texts and texts without words have fingerprint zero, which is linked like any other. Texts of fewer than
three words have their whole sequence as one shingle. Very long texts are read in pieces. Rows that repeat an
id are rows of their own. A row without an id links others through its fingerprint; its component_id is the
least id of its component, null if it has none. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop_cut, flagged, small_batches
from .near_dedup import components, joined
from .shingles import steps

BITS, WORDS, SEED = 64, 3, 42
#: Bytes of one text that are cut into words at a time.
PIECE = 1 << 20
#: A link of three bits leaves five of eight bytes untouched.
BYTES, UNTOUCHED = 8, 5

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def shingle_hashes(text: bytes, piece: int = PIECE) -> Iterator[list[int]]:
    """XXH64 of each shingle of a text, in order, piece by piece."""
    digest, at, held, none = xxhash.xxh64_intdigest, 0, [], True
    while at < len(text):
        stop = _SPACE.search(text, at + piece) if at + piece < len(text) else None
        end = stop.start() if stop else len(text)
        words = held + text[at:end].lower().split()
        if len(words) >= WORDS:
            none = False
            yield [digest(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(WORDS)), strict=False)]
        held, at = words[-(WORDS - 1) :], end
    if none and held:
        yield [digest(b" ".join(held), SEED)]


def _ones(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of texts, as uint64."""
    ones, total = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    runs: list[list[int]] = []
    owners: list[int] = []

    def summed() -> None:
        if runs:
            sizes = np.array([len(r) for r in runs])
            counts = _ones(np.array([h for r in runs for h in r], np.uint64), np.cumsum(sizes) - sizes)
            np.add.at(ones, owners, counts)
            np.add.at(total, owners, sizes)
            runs.clear()
            owners.clear()

    size = 0
    for k, text in enumerate(texts):
        for run in shingle_hashes(text):
            runs.append(run)
            owners.append(k)
            size += len(run)
            if size > PIECE // 8:
                summed()
                size = 0
    summed()
    over = 2 * ones > total[:, None]
    return np.packbits(over.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in steps(batch.column(1).cast(pa.large_binary())):
            fp = fingerprints_of(texts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_fingerprint, "doc_id long, fp long")


def _emit(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row with ``key`` for each variant of a fingerprint ``id``."""
    variants = F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")
    return fps.select("*", variants).withColumn("key", F.col("id").bitwiseXOR(F.col("mask"))).drop("mask")


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column id) within two bits of each other."""
    balls = _emit(fps.select("id"), [0] + [1 << k for k in range(BITS)])
    met = balls.withColumn("least", F.min("id").over(Window.partitionBy("key"))).where("id <> least")
    return met.select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()


def may_join(labels: DataFrame) -> DataFrame:
    """Of fingerprints with components (id, label), those that agree with one of another component in UNTOUCHED bytes."""
    masks = [sum(0xFF << (8 * k) for k in kept) for kept in combinations(range(BYTES), UNTOUCHED)]
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(_signed(m)).alias("mask")) for n, m in enumerate(masks)]))
    keys = labels.select("id", "label", table.alias("t")).select("id", "label", F.col("t.n").alias("n"), F.col("id").bitwiseAND(F.col("t.mask")).alias("key"))
    mixed = cut(keys.groupBy("n", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("n", "key"))
    hashed = mixed.select(F.xxhash64("n", "key"))
    some = flagged(keys, F.xxhash64("n", "key"), hashed, "among").where("among")
    found = cut(some.join(mixed, ["n", "key"], "left_semi").select("id", "label").distinct())
    drop_cut(mixed)
    return found


def far_links(open_: DataFrame) -> DataFrame:
    """Links (a, b) of three bits between components of (id, label)."""
    odd = F.bit_count("id") % 2 == 1
    met = _emit(open_.where(~odd), [1 << k for k in range(BITS)]).groupBy("key").agg(F.min_by("id", "label").alias("a"), F.min("label").alias("label_a"))
    met = cut(met)
    pairs = _emit(open_.where(odd), [1 << i | 1 << j for i, j in combinations(range(BITS), 2)])
    pairs = flagged(pairs, F.xxhash64("key"), met.select(F.xxhash64("key")), "among").where("among")
    return pairs.join(met, "key").where("label <> label_a").select("a", F.col("id").alias("b")).distinct()


def simhash_components(prints: DataFrame) -> DataFrame:
    """Component (id, label: its least fingerprint) of each distinct fingerprint of ``prints`` (id)."""
    labels = components(prints, near_links(prints))
    return joined(labels, cut(far_links(may_join(labels))))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (least id of its component)."""
    with small_batches(docs.sparkSession):
        rows = cut(fingerprints(docs, id_col, text_col))
    prints = cut(rows.groupBy(F.col("fp").alias("id")).agg(F.min("doc_id").alias("least")))
    labels = simhash_components(prints.select("id")).join(prints, "id")
    least = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labels.join(least, "label").select(F.col("id").alias("fp"), "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
