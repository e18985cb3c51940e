"""Toxicity by compression distance between zstandard dictionaries.

Two dictionaries are trained on labelled text: one on ordinary windows, one on what recurs in toxic
texts and never occurs in ordinary ones (runs of bytes whose n-grams are in several distinct toxic
texts and in no ordinary one; of near copies, told by their whole sampled texts, one counts). Every window of every whole text is compressed with the ordinary
dictionary, and with both put together: the bytes that the toxic dictionary saves are the window's
distance. A logistic calibration, fitted by Newton's method to the same bounded sample, maps a text's
distances to a score between 0 and 1; 0.7 and more is predicted toxic.

The sample has at most ``sample`` documents of each label and ``span`` characters of each (documented
bounds), all with crc32(id) mod 3 other than 1. Labels are inputs of nothing else.

Nulls and empty texts: scored like one empty window. A document with several labels counts as toxic
if one says so; null labels are skipped. Without labels of both kinds every score is 0.
Repeated rows get the same score. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType

WINDOW, STRIDE = 64, 48
#: Most documents of each label in the training sample, and characters of each.
SAMPLE, SPAN = 2000, 16000
GRAM = 6
SLOTS = 24
ORDINARY_BYTES, TOXIC_BYTES = 32768, 1024
LEVEL = 3
#: A toxic n-gram is in at least this many, and this share, of the distinct toxic texts.
LEAST, SHARE = 3, 0.03
THRESHOLD = 0.7
#: Toxic texts that share this much of their n-grams are near copies; they meet by one of so many least hashes.
COPY, PROBES = 0.8, 16


@lru_cache(maxsize=8)
def _compressor(content: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STRIDE)), STRIDE)]


def grams(text: bytes) -> np.ndarray:
    """Slots of the n-grams of a text, by place."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(a) < GRAM:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(257) + a[j : len(a) - GRAM + 1 + j]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def runs(text: bytes, wanted: np.ndarray) -> list[bytes]:
    """The runs of bytes of a text that wanted n-grams cover."""
    hit = wanted[grams(text)]
    cover = np.zeros(len(text) + 2, np.int8)
    for j in range(GRAM):
        cover[1 + j : 1 + j + len(hit)] |= hit
    edge = np.diff(cover)
    return [text[a:b] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary; of too few samples, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def features(self, text: bytes) -> np.ndarray:
        one, both = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        saved = np.array([len(one.compress(w)) - len(both.compress(w)) for w in windows(text.lower())], float)
        top = np.sort(saved)[::-1]
        over = np.maximum(saved - 1, 0).sum()
        return np.array([top[0], top[:3].mean(), saved.mean(), over / np.sqrt(len(saved)), np.log1p(over), np.log(len(saved))])

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.centre) / self.scale) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a ridge-penalised logistic regression, by Newton's method, and the features' centre and scale."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - centre) / scale]
    w = np.zeros(a.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    return w, centre, scale


def apart(texts: list[bytes]) -> list[bytes]:
    """Texts without near copies, of which the first stays: whole texts are compared, by the overlap of their n-grams."""
    first: dict[int, list[int]] = {}
    kept: list[tuple[bytes, np.ndarray]] = []
    for t in dict.fromkeys(texts):
        mine = np.unique(grams(t))
        least = np.sort((mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40))[:PROBES].tolist()
        for i in sorted({i for h in least for i in first.get(h, ())}):
            both = len(np.intersect1d(mine, kept[i][1], assume_unique=True))
            if both >= COPY * (len(mine) + len(kept[i][1]) - both):
                break
        else:
            for h in least:
                first.setdefault(h, []).append(len(kept))
            kept.append((t, mine))
    return [t for t, _ in kept]


def fit(ordinary: list[bytes], toxic: list[bytes]) -> Model:
    ordinary, toxic = [t.lower() for t in ordinary], [t.lower() for t in toxic]
    count = np.zeros(1 << SLOTS, np.int32)
    distinct = apart(toxic)
    for t in distinct:
        count[np.unique(grams(t))] += 1
    wanted = count >= max(LEAST, int(SHARE * len(distinct)))
    for t in ordinary:
        wanted[grams(t)] = False
    found = [b"\n".join(r) for t in distinct if (r := runs(t, wanted))]
    parts = [f[i : i + 256] for f in found for i in range(0, len(f), 256)]
    common = _dictionary([w for t in ordinary for w in windows(t) if len(w) > 8], ORDINARY_BYTES, 64, 8)
    model = Model(common, _dictionary(parts, TOXIC_BYTES, 64, 6), np.zeros(7), np.zeros(6), np.ones(6))
    x = np.array([model.features(t) for t in ordinary + toxic])
    model.weights, model.centre, model.scale = calibrate(x, np.r_[np.zeros(len(ordinary)), np.ones(len(toxic))])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, span: int = SPAN) -> Model | None:
    ids = F.col("id").cast("string")
    by_id = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.crc32(ids.cast("binary")) % 3 != 1))
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    place = F.xxhash64(ids, F.lit("sample"))
    chosen = [by_id.where(F.col("label") == k).orderBy(place, "id").limit(sample) for k in (0, 1)]
    at = F.pmod(F.xxhash64(ids, F.lit("place")), F.greatest(F.lit(1), F.length("text") - span)).cast("int") + 1
    rows = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")  # at most 2 * sample rows
        .select("id", "label", F.substring("text", at, F.lit(span)).alias("text")).toPandas().sort_values(["id", "text"])
    )
    texts = [[t.encode() for t in rows["text"][rows["label"] == k]] for k in (0, 1)]
    return fit(*texts) if texts[0] and texts[1] else None


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, span: int = SPAN) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, label_col, sample, span)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    given = docs.select(F.col(id_col).alias("doc_id"), held_out, F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            score = model.score(np.array([model.features(t.as_py()) for t in texts])) if model and len(texts) else np.zeros(len(texts))
            score = np.round(score, 9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    schema = StructType([given.schema["doc_id"]]).add("held_out", BooleanType()).add("score", DoubleType()).add("predicted", IntegerType())
    return given.mapInArrow(run, schema)
