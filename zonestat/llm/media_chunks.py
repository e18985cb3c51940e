"""Media payloads stored as content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has its top bits zero. Chunks are
8-bit samples, named by their SHA-256 digest and stored once: Spark drops repeated digests, first in
each task, then by a shuffle on the digest. A payload's ordered chunk list, joined to the chunk
store, gives its stored form back: a header, the list, and the chunks' zstandard frames. Reading it
back checks each chunk against its digest and the whole against the payload's own digest.

Nulls and empty texts: the payload is padding alone. Equal texts have one stored form. Repeated rows and
null ids keep their rows. A long payload is held by one task at a time, one payload per group.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 576
LEAST, MOST = 2048, 32768
#: Cuts come every 2 ** CUT_BITS bytes, about, after the least chunk size.
CUT_BITS = 12
LEVEL = 9
#: Bytes of payload that one step of a batch cuts.
STEP = 4_000_000
MAGIC = b"ZCHUNKS1"
#: The gear table: by rule, the first four bytes of each byte value's digest.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there (by doubling: 5 passes, not 32)."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        # a sum over 2w bytes is the sum over the last w and, shifted by w, over the w before
        h[width:] += h[:-width] << np.uint32(width)
    return h


def cuts(size: int, places: np.ndarray) -> list[int]:
    """Where the chunks of a payload end; ``places`` are the ends that the hash allows, in order."""
    ends, start = [], 0
    while size - start > LEAST:
        k = np.searchsorted(places, start + LEAST)
        end = min(int(places[k]) if k < len(places) else size, start + MOST, size)
        ends.append(end)
        start = end
    return ends + [size] if start < size else ends


def payload(text: bytes) -> bytes:
    """The text's bytes and 255s up to a positive multiple of BLOCK."""
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def chunked(texts: list[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Payloads and their chunks."""
    payloads = [payload(t) for t in texts]
    data = np.frombuffer(b"".join(payloads), np.uint8)
    allowed = np.flatnonzero(gear_hash(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    at = 0
    for p in payloads:
        # windows of ends after LEAST lie within the payload
        near = allowed[np.searchsorted(allowed, at + LEAST) : np.searchsorted(allowed, at + len(p), "right")] - at
        ends = cuts(len(p), near)
        yield p, [p[a:b] for a, b in zip([0, *ends], ends)]
        at += len(p)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        held, size = [], 0
        for t in batch.column(0).cast(pa.large_binary()):
            held.append(t.as_py())
            size += len(held[-1])
            if size > STEP:
                yield held
                held, size = [], 0
        if held:
            yield held


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk lists, once for each payload in a task."""
    import zstandard  # noqa: F401  the same libraries in both passes

    seen: set[bytes] = set()
    for texts in _steps(batches):
        rows = []
        for p, parts in chunked(texts):
            name = hashlib.sha256(p).digest()
            if name not in seen:
                seen.add(name)
                rows += [(name, k, hashlib.sha256(c).digest(), len(parts)) for k, c in enumerate(parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.binary(), pa.int32()))], names=["payload", "seq", "digest", "of"]
        )


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks' stored bytes, once for each digest in a task."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=LEVEL)
    seen: set[bytes] = set()
    for texts in _steps(batches):
        names, stored = [], []
        for _, parts in chunked(texts):
            for c in parts:
                name = hashlib.sha256(c).digest()
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    stored.append(pack.compress(c))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(stored, pa.binary())], names=["digest", "stored"])


def container(digests: list[bytes], stored: list[bytes]) -> bytes:
    """A payload's stored form: header, ordered chunk list, frames."""
    head = MAGIC + struct.pack("<I", len(digests))
    return head + b"".join(d + struct.pack("<I", len(s)) for d, s in zip(digests, stored, strict=True)) + b"".join(stored)


def read_back(media: bytes) -> bytes:
    """The payload of a stored form; each chunk is checked against its digest."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    if media[: len(MAGIC)] != MAGIC:
        raise ValueError("not a chunked payload")
    (n,) = struct.unpack_from("<I", media, len(MAGIC))
    entries = [struct.unpack_from("<32sI", media, len(MAGIC) + 4 + 36 * k) for k in range(n)]
    at, parts = len(MAGIC) + 4 + 36 * n, []
    for digest, size in entries:
        parts.append(unpack.decompress(media[at : at + size], max_output_size=MOST + LEAST))
        at += size
        if hashlib.sha256(parts[-1]).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} is damaged")
    return b"".join(parts)


def feature(samples: bytes) -> str:
    """Level, loudness, sign changes about the middle, and peak of unsigned 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};changes={changes};peak={int(np.abs(x).max())}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, parts in zip(batch.column(0), batch.column(1), strict=True):
            parts = parts.as_py()
            media = container([p["digest"] for p in parts], [p["stored"] for p in parts])
            back = read_back(media)
            digest = hashlib.sha256(back).digest()
            if digest != name.as_py():
                raise ValueError(f"payload {name.as_py().hex()} isn't what was stored")
            rows.append((digest, len(back), digest.hex(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back), len(parts)))
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        names = ["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def chunk_store(texts: DataFrame) -> DataFrame:
    """Distinct chunks of a column of texts: digest, stored (a zstandard frame)."""
    return texts.mapInArrow(_store, "digest binary, stored binary").dropDuplicates(["digest"])


def chunk_lists(texts: DataFrame) -> DataFrame:
    """Ordered chunk lists of distinct payloads: payload (its digest), seq, digest, of (how many chunks)."""
    return texts.mapInArrow(_lists, "payload binary, seq int, digest binary, of int").dropDuplicates(["payload", "seq"])


def reconstruct(lists: DataFrame, store: DataFrame) -> DataFrame:
    """What each payload's stored form reads back as."""
    part = F.struct("seq", "digest", "stored")
    whole = lists.where("of = 1").join(store, "digest").select("payload", F.array(part).alias("parts"))  # needs no second shuffle
    several = lists.where("of > 1").join(store, "digest").groupBy("payload").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    kinds = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"
    return whole.unionByName(several).mapInArrow(_read, kinds)


def payload_digest(text: Column) -> Column:
    size = F.octet_length(text)
    padding = F.when(size == 0, F.lit(BLOCK)).otherwise(F.pmod(-size, F.lit(BLOCK)))
    return F.unhex(F.sha2(F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit("FF"), padding))), 256))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks."""
    text = F.coalesce(text_col, F.lit(""))
    texts = docs.select(text.alias("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), payload_digest(text).alias("payload"))
    return rows.join(reconstruct(chunk_lists(texts), chunk_store(texts)), "payload", "left").drop("payload")
