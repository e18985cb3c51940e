"""Word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs alone give equal outputs."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 19)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


_LETTER = np.zeros(256, bool)
_LETTER[:] = True
_LETTER[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, runs of other bytes than white space), how many words
    each text has, and where each word lies in the joined texts (start, end as two columns)."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = _LETTER[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    h = mix((total[end] - total[start]) * down[start])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, starts))
    return h, counts, np.stack([start, end], axis=1)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles, and how many each text has; a text of fewer words has its whole sequence as one."""
    n = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = np.repeat(first + counts, n)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        there = at + j < last
        h = h * np.uint64(_BASE) + np.where(there, padded[at + j], np.uint64(0))
        h = mix(h + np.uint64(j + 1))
    return h, n


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts, _ = word_hashes(texts)
    h, n = shingle_hashes(words, counts, k)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return np.split(h, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) if texts else []


def steps(texts, limit: int = 500_000):
    """Runs of texts (an Arrow binary array) of about ``limit`` bytes, one text at least: their offset and bytes."""
    held, size, at = [], 0, 0
    for k, t in enumerate(texts):
        t = t.as_py() or b""
        if held and size + len(t) > limit:
            yield at, held
            held, size, at = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (the second of two columns) as zstandard frames: pairs of texts are shuffled and held that way."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        frames = [pack.compress(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.binary())], names=["id", "text"])


def unpacked(texts, limit: int = 500_000):
    """Runs of packed texts of about ``limit`` bytes, one at least: their offset and bytes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    held, size, at = [], 0, 0
    for k, t in enumerate(texts):
        t = unpack.decompress(t.as_py())
        if held and size + len(t) > limit:
            yield at, held
            held, size, at = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield at, held
