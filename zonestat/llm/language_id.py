"""Language identification by a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window and mapped to
languages by a softmax. The network is trained in numpy on the driver, on at most ``sample`` windows
of labelled text (a documented bound; one window per document, at a place that its id's hash gives),
which are shared out by the counts of eligible rows, so that every language is learned at every size.
Every whole text is then read in fixed-length windows, in batches: a document's language has the
largest mean log-probability over its windows, weighted by their bytes.

For prediction the filters are folded into tables: what a pair of bytes adds to each filter at each
offset is looked up, so a width-4 filter takes two look-ups and no multiplication.

Nulls and texts without a letter: ``und`` with score 0. A null language or id is never learned from.
Equal texts get equal results. Without labelled rows (an empty table) all is ``und``.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
#: Most training windows that come to the driver.
SAMPLE = 4000
#: Windows that a language has in the sample at least, if it has so many rows.
FEW = 100
#: Steps of Adam, over however many passes of the sample.
STEPS = 350
BATCH = 64


class ByteConvNet:
    def __init__(self, classes: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.classes = classes
        p = {"embed": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
            p[f"b{w}"] = np.zeros(FILTERS)
        p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes)))
        p["bias"] = np.zeros(len(classes))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled activations of windows x and, by width, where each filter's maximum lies."""
        e = self.p["embed"][x]
        pooled, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            patches = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x) * n, w * EMBED)
            a = (patches @ self.p[f"w{w}"].reshape(w * EMBED, FILTERS)).reshape(len(x), n, FILTERS)
            at = a.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(a, at[:, None], 1)[:, 0] + self.p[f"b{w}"])
        return np.concatenate(pooled, axis=1), where

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 4e-3, batch: int = BATCH) -> None:
        """Adam on the cross-entropy; gradients pass a max-pool only where its maximum lies."""
        rng = np.random.default_rng(11)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, epochs = 0, max(1, round(steps * batch / max(1, len(x))))
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                mine = order[at : at + batch]
                xb, step = x[mine], step + 1
                z, where = self._pool(xb)
                h = np.maximum(z, 0)
                d = _softmax(h @ self.p["out"] + self.p["bias"])
                d[np.arange(len(mine)), y[mine]] -= 1
                d /= len(mine)
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                g["out"], g["bias"] = h.T @ d, d.sum(0)
                dz = (d @ self.p["out"].T) * (z > 0)
                for k, (w, place) in enumerate(zip(WIDTHS, where, strict=True)):
                    dk = dz[:, k * FILTERS : (k + 1) * FILTERS]
                    g[f"b{w}"] = dk.sum(0)
                    for j in range(w):
                        codes = np.take_along_axis(xb, place + j, 1)
                        g[f"w{w}"][j] = np.einsum("nfe,nf->ef", self.p["embed"][codes], dk)
                        np.add.at(g["embed"], codes, dk[:, :, None] * self.p[f"w{w}"][j].T[None])
                lr = rate * (1 - epoch / epochs)
                for k, v in g.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.999 * square[k] + 0.001 * v * v
                    self.p[k] -= lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z, _ = self._pool(x)
        return np.log(_softmax(np.maximum(z, 0) @ self.p["out"] + self.p["bias"]) + 1e-9)

    def folded(self) -> Folded:
        return Folded(self)


class Folded:
    """The same network with its filters folded into tables by pairs of bytes."""

    def __init__(self, net: ByteConvNet) -> None:
        self.classes, self.net = net.classes, net
        self.pair_tables: list[tuple[int, np.ndarray]] | None = None

    def _tables(self) -> None:
        p = self.net.p
        single = {w: np.einsum("ce,jef->jcf", p["embed"], p[f"w{w}"]) for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        self.by_width = [[(j, pair(s[j], s[j + 1])) if j + 1 < w else (j, s[j]) for j in range(0, w, 2)] for w, s in single.items()]

    def log_probabilities(self, x: np.ndarray, step: int = 48) -> np.ndarray:
        if self.pair_tables is None:
            self._tables()
            self.pair_tables = []
        p, n = self.net.p, x.shape[1]
        pooled = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for at in range(0, len(x), step):
            one = x[at : at + step]
            two = one[:, :-1].astype(np.uint16) * np.uint16(256) + one[:, 1:]
            for k, (w, tables) in enumerate(zip(WIDTHS, self.by_width, strict=True)):
                total = None
                for j, t in tables:
                    codes = (two if len(t) > 256 else one)[:, j : j + n - w + 1]
                    total = t.take(codes, axis=0) if total is None else np.add(total, t.take(codes, axis=0), out=total)
                pooled[at : at + step, k * FILTERS : (k + 1) * FILTERS] = total.max(axis=1) + p[f"b{w}"]
        return np.log(_softmax(np.maximum(pooled, 0) @ p["out"] + p["bias"]) + 1e-9)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def as_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts in ``data``: where each starts, its bytes, and its text. A text has one window at least."""
    count = np.maximum(1, -(-(ends - starts) // WINDOW))
    owner = np.repeat(np.arange(len(starts)), count)
    start = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    return start, np.minimum(WINDOW, ends[owner] - start), owner


def matrix(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Windows as rows of bytes, zero after their end. ``data`` has WINDOW more bytes than texts."""
    place = np.arange(WINDOW)
    return np.where(place[None, :] < length[:, None], data[start[:, None] + place[None, :]], 0).astype(np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string column (and WINDOW zeros), and where each text starts and ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    got = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.concatenate([got, np.zeros(WINDOW, np.uint8)]), ends[:-1] - ends[0], ends[1:] - ends[0]


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Training windows of each language, ``sample`` in all if there are so many: in proportion to its rows, but FEW at least
    (less where that many don't fit for all)."""
    few = max(1, min(FEW, sample // len(counts)))
    least = {k: min(n, few) for k, n in counts.items()}
    left = max(0, min(sample, sum(counts.values())) - sum(least.values()))
    over = sum(counts.values()) - sum(least.values())
    return {k: least[k] + (left * (n - least[k]) // over if over else 0) for k, n in counts.items()}


def train(docs: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Folded | None:
    """A network fitted to rows whose crc32(id) mod 3 isn't 1; None if no row has a label."""
    ids = F.col(id_col).cast("string")
    place = F.pmod(F.xxhash64(ids, F.lit("place")), F.greatest(F.lit(1), F.length(text_col) - WINDOW)).cast("int") + 1
    label = F.col(label_col).cast("string")
    eligible = docs.where(F.col(label_col).isNotNull() & (F.crc32(ids.cast("binary")) % 3 != 1) & F.col(text_col).rlike(r"\p{L}"))
    counts = {r["label"]: r["n"] for r in eligible.groupBy(label.alias("label")).agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    wanted = quotas(counts, sample)
    # somewhat more than its quota of each language passes the threshold, however many rows there are: tasks send little to the driver
    most = {k: min(1.0, (2 * q + 40) / counts[k]) for k, q in wanted.items()}
    bound = F.create_map(*[F.lit(x) for k in most for x in (k, int(most[k] * (1 << 40)))])
    drawn = F.pmod(F.xxhash64(ids, F.lit("sample")), F.lit(1 << 40)) < F.element_at(bound, label)
    rows = (
        eligible.where(drawn)
        .select(F.xxhash64(ids).alias("at"), F.substring(text_col, place, F.lit(WINDOW)).alias("window"), label.alias("label")).toPandas()
        .sort_values(["at", "window", "label"])
    )
    rows = rows[rows.groupby("label").cumcount() < rows["label"].map(wanted)]
    if rows.empty:
        return None
    classes = sorted(rows["label"].unique())
    data, starts, ends = text_bytes(pa.array(rows["window"], pa.string()))
    net = ByteConvNet(classes)
    net.fit(matrix(data, starts, np.minimum(ends - starts, WINDOW)), np.searchsorted(classes, rows["label"].to_numpy(str)))
    return net.folded()


def language_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, keep: bool = False
) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. With ``keep``, all columns of docs, then the two of
    the prediction, whatever their names."""
    net = train(docs, id_col, text_col, label_col, sample)
    ids = F.col(id_col).cast("string")
    held_out = F.coalesce(F.crc32(ids.cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    text = F.coalesce(text_col, F.lit(""))
    own = docs.select("*") if keep else docs.select(F.col(id_col).alias("doc_id"), held_out)
    letter = F.when(text.rlike(r"\p{L}"), text).otherwise("").alias(fresh(docs, "lettered"))
    given = docs.select(*([F.col(c) for c in docs.columns] if keep else [F.col(id_col).alias("doc_id"), held_out]), letter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column(batch.num_columns - 1)
            data, starts, ends = text_bytes(lettered)
            total = np.zeros((len(lettered), len(net.classes) if net else 1))
            if net:
                start, length, owner = as_windows(data, starts, ends)
                for at in range(0, len(start), 4096):
                    part = slice(at, at + 4096)
                    logs = net.log_probabilities(matrix(data, start[part], length[part]))
                    np.add.at(total, owner[part], logs * length[part, None])
            p = _softmax(total / np.maximum(ends - starts, 1)[:, None])
            known = (ends > starts) & (net is not None)
            names = np.array(net.classes if net else ["und"], dtype=object)
            out = [c for c in batch.columns[:-1]]
            out += [pa.array(np.where(known, names[p.argmax(1)], "und"), pa.string()), pa.array(np.where(known, p.max(1), 0.0).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(out, names=names_out)

    from pyspark.sql.types import DoubleType, StringType, StructType

    added = [fresh(docs, "lang_pred"), fresh(docs, "score")] if keep else ["lang_pred", "score"]
    schema = StructType(own.schema.fields).add(added[0], StringType()).add(added[1], DoubleType())
    names_out = schema.names
    return given.mapInArrow(run, schema)
