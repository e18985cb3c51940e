"""Hard negatives by a kNN join over Voronoi cells.

Scores are inner products of integer vectors. With one more component, sqrt(M - |v|^2) for a row (M the largest square
of a norm) and 0 for an anchor, all rows have one norm, so the best score is the least distance and the triangle
inequality holds. Pivots (cluster centres of a bounded sample) cut the space into cells; a row and an anchor belong to
their nearest pivot's.

A search asks for the first k rows of each query: an anchor, the same label or another one, a band of scores. First
each cell's anchors meet their own cell's rows. The worst score that a query of a cell then still accepts, and
the range of its anchors' distances to every pivot, bound what any other row could do there: a row is sent only to
cells where its best possible score reaches that and its least possible one isn't above the band. Rows meet anchors
exactly: a task gets some of a cell's anchors (at most about ANCHORS) and a salted part of its rows (about ROWS), and
reads them as a stream with the best k of each query at hand. No row is left out by anything but a proven bound.

Broadcast are PIVOTS centres at most and a few numbers for each pair of them.

Rows without id, label or vector, or with a null or non-finite component, take no part. Vectors of unequal lengths
count as if filled up with zeros. Anchors that repeat an id count once, with the least (label, vector); other rows that
repeat an id are rows of their own, and none with an anchor's id is among its positives. Scores are 64-bit integers:
vectors whose products leave them are out of range. Other columns are ignored; without anchors there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shuffle_partitions

#: Rows that pivots are fitted on, and the most pivots.
SAMPLE, PIVOTS = 2048, 128
#: Anchors for one pivot, about; anchors of one task, about; rows of one task, about.
EACH, ANCHORS, ROWS = 128, 2048, 16384
#: Scores that are compared at a time.
CELLS = 1 << 22
ANY = 1 << 62


def integer_vectors(rows: DataFrame, vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    xs = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(xs, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.when(finite, F.transform(xs, lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of int64, filled up with zeros to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()[column.offsets[0].as_py() :][: lengths.sum()]
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Space:
    """Pivots, and distances to them in the augmented space."""

    def __init__(self, pivots: np.ndarray, largest: float) -> None:
        self.pivots, self.largest, self.width = pivots, largest, pivots.shape[1] - 1

    def distances(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        x = vectors.astype(np.float64)
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1), 0))
        x = np.column_stack([x, last])
        squares = (x * x).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def place(self, anchors: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Adds each vector's cell."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = self.distances(_matrix(batch.column(2), self.width), anchors).argmin(axis=1) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "label", "vector", "cell"])

        return run


def fit(rows: DataFrame, anchors: int) -> Space:
    """Pivots from SAMPLE rows: as many as EACH anchors have one, PIVOTS at most, moved to their rows' means."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    known = rows.agg(F.max(square).alias("square"), F.max(F.size("vector")).alias("width")).first()
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    width, largest = known["width"] or 0, known["square"] or 0.0
    x = np.zeros((len(drawn), width + 1))
    for k, (v,) in enumerate(drawn):
        x[k, : len(v)] = v
    x[:, -1] = np.sqrt(np.maximum(largest - (x[:, :-1] ** 2).sum(axis=1), 0))
    n = min(PIVOTS, max(1, round(anchors / EACH)), max(1, len(np.unique(x, axis=0))))
    pivots = x[np.random.default_rng(13).permutation(len(x))[:n]] if len(x) else np.zeros((1, width + 1))
    for _ in range(10):
        near = ((x * x).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1) if len(x) else np.zeros(0, int)
        pivots = np.array([x[near == k].mean(axis=0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
    return Space(pivots, largest)


class Bounds:
    """By cell: tasks for its anchors, the range of their distances to each pivot and of their norms; no tasks where there are none."""

    def __init__(self, space: Space, placed: DataFrame) -> None:
        n = len(space.pivots)
        self.chunks, self.low, self.high = np.zeros(n, np.int64), np.full((n, n), np.inf), np.full((n, n), -np.inf)
        self.norm = np.tile([np.inf, -np.inf], (n, 1))

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors, cells = _matrix(batch.column(2), space.width), batch.column(3).to_numpy()
                d = space.distances(vectors, True)
                squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
                for c in np.unique(cells):
                    mine = cells == c
                    low, high, norm, many = held.setdefault(int(c), [np.full(n, np.inf), np.full(n, -np.inf), np.array([np.inf, -np.inf]), 0])
                    held[int(c)] = [np.minimum(low, d[mine].min(axis=0)), np.maximum(high, d[mine].max(axis=0)), np.array([min(norm[0], squares[mine].min()), max(norm[1], squares[mine].max())]), many + int(mine.sum())]
            at = [[c, j, float(x[0][j]), float(x[1][j]), float(x[2][0]), float(x[2][1]), x[3]] for c, x in held.items() for j in range(n)]
            kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in at], kind) for k, kind in enumerate(kinds)], names=["cell", "pivot", "low", "high", "least", "most", "n"])

        parts = placed.mapInArrow(ranges, "cell int, pivot int, low double, high double, least double, most double, n long")
        whole = parts.groupBy("cell", "pivot").agg(F.min("low"), F.max("high"), F.min("least"), F.max("most"), F.sum("n"))
        for c, j, low, high, least, most, many in whole.collect():  # a row for each pair of pivots
            self.low[c, j], self.high[c, j], self.norm[c] = low, high, (least, most)
            self.chunks[c] = -(-many // ANCHORS)

    def route(self, space: Space, accepts: dict[int, tuple[int, int]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Rows by the tasks they go to: those of their own cell, or, by the scores that other cells accept, of those."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                home = batch.column(3).to_numpy().astype(np.int64)
                if accepts is None:
                    at, to = np.flatnonzero(self.chunks[home] > 0), home[self.chunks[home] > 0]
                else:
                    d = space.distances(_matrix(batch.column(2), space.width), False)
                    found = []
                    for c, (least, most) in accepts.items():
                        nearest = np.maximum(0, np.maximum(d - self.high[c], self.low[c] - d).max(axis=1))
                        farthest = (d + self.high[c]).min(axis=1)
                        slack = 1 + 1e-6 * (space.largest + self.norm[c, 1])
                        could = (self.norm[c, 1] + space.largest - nearest**2) / 2 + slack >= least
                        could &= (self.norm[c, 0] + space.largest - farthest**2) / 2 - slack <= most
                        found.append(np.flatnonzero(could & (home != c)))
                    at = np.concatenate(found) if found else np.zeros(0, np.int64)
                    to = np.repeat(np.fromiter(accepts, np.int64, len(accepts)), [len(f) for f in found]) if found else at
                many = self.chunks[to]
                chunk = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at, to = np.repeat(at, many), np.repeat(to, many)
                for k in range(0, max(len(at), 1), 10_000):
                    rows = batch.take(pa.array(at[k : k + 10_000]))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(to[k : k + 10_000].astype(np.int32)), pa.array(chunk[k : k + 10_000].astype(np.int32))], names=["id", "label", "vector", "cell", "chunk"])

        return run


class _Best:
    """The first k rows of each of a task's queries, as its rows come by."""

    def __init__(self, k: int, same: bool, width: int) -> None:
        self.k, self.same, self.width = k, same, width
        self.asked: list[pa.RecordBatch] = []
        self.ready = False

    def ask(self, batch: pa.RecordBatch) -> None:
        self.asked.append(batch)

    def _prepare(self) -> None:
        rows = pa.Table.from_batches(self.asked).combine_chunks().to_batches()[0]
        self.anchor, self.p, self.label, self.lo, self.hi = (rows.column(c).to_numpy() for c in ("id", "p", "label", "lo", "hi"))
        ids, first, self.of = np.unique(self.anchor, return_index=True, return_inverse=True)
        self.vectors = _matrix(rows.column("vector"), self.width)[first]
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = self.lo.copy()
        self.ready = True

    def meet(self, batch: pa.RecordBatch) -> None:
        if not self.asked:
            return
        if not self.ready:
            self._prepare()
        step = max(1, CELLS // len(self.anchor))
        ids, labels, vectors = batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("vector"), self.width)
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            scores = _product(self.vectors, vectors[part])[self.of]
            fits = (self.label[:, None] == labels[part]) == self.same
            fits &= (scores >= self.least[:, None]) & (scores <= self.hi[:, None])
            if self.same:
                fits &= self.anchor[:, None] != ids[part]
            q, r = np.nonzero(fits)
            if not len(q):
                continue
            query, score, found = np.r_[self.query, q], np.r_[self.score, scores[q, r]], np.r_[self.id, ids[part][r]]
            order = np.lexsort((found, -score, query))
            query, score, found = query[order], score[order], found[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            keep = rank < self.k
            self.query, self.score, self.id = query[keep], score[keep], found[keep]
            full = rank == self.k - 1
            self.least[query[full]] = score[full]

    def out(self) -> pa.RecordBatch:
        if not self.ready:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["anchor_id", "p", "id", "score"])
        return pa.RecordBatch.from_arrays([pa.array(self.anchor[self.query]), pa.array(self.p[self.query].astype(np.int32)), pa.array(self.id), pa.array(self.score)], names=["anchor_id", "p", "id", "score"])


def _join(k: int, same: bool, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A stream of tasks' rows, each task's queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, best = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "chunk", "salt", "kind")])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                if tuple(keys[a, :3]) != task:
                    if best is not None:
                        yield best.out()
                    task, best = tuple(keys[a, :3]), _Best(k, same, width)
                (best.meet if keys[a, 3] else best.ask)(batch.slice(a, b - a))
        if best is not None:
            yield best.out()

    return run


def search(space: Space, bounds: Bounds, queries: DataFrame, rows: DataFrame, salts: int, k: int, same: bool) -> DataFrame:
    """The first k rows of each query: (anchor_id, p, rank, id, score).

    ``queries`` has id (the anchor's), p (which of its queries), label, vector, cell, lo and hi; ``rows`` has id, label, vector, cell.
    """
    counts = F.element_at(F.array(*[F.lit(int(max(c, 1))) for c in bounds.chunks]), F.col("cell") + 1)
    asked = queries.select("cell", F.pmod(F.xxhash64("id"), counts).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "id", "p", "label", "vector", "lo", "hi")

    def met(accepts: dict[int, tuple[int, int]] | None) -> DataFrame:
        sent = rows.select("id", "label", "vector", "cell").mapInArrow(bounds.route(space, accepts), "id long, label long, vector array<long>, cell int, chunk int")
        none = F.lit(None).cast("long")
        sent = sent.select("cell", "chunk", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", F.lit(0).alias("p"), "label", "vector", none.alias("lo"), none.alias("hi"))
        wanted = asked if accepts is None else asked.where(F.col("cell").isin(list(accepts)))
        both = wanted.unionByName(sent).repartition(shuffle_partitions(rows.sparkSession), "cell", "chunk", "salt").sortWithinPartitions("cell", "chunk", "salt", "kind")
        return both.mapInArrow(_join(k, same, space.width), "anchor_id long, p int, id long, score long")

    ranked = Window.partitionBy("anchor_id", "p").orderBy(F.desc("score"), "id")
    first = lambda df: df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    home = cut(first(met(None)))
    worst = home.where(F.col("rank") == k).select(F.col("anchor_id").alias("id"), "p", "score")
    least = queries.join(worst, ["id", "p"], "left").groupBy("cell").agg(F.min(F.coalesce("score", "lo")), F.max("hi"))
    accepts = {c: (lo, hi) for c, lo, hi in least.collect()}  # a row for each pivot
    if not accepts:
        return home.select("anchor_id", "p", "rank", "id", "score")
    return cut(first(home.drop("rank").unionByName(met(accepts))).select("anchor_id", "p", "rank", "id", "score"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor of ``rows`` (id long, label long, vector array<long>) and each of its first rows of the same label, the
    first rows of other labels whose score is between ``low`` and ``high`` per cent of the positive's.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    chosen = cut(usable.where(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).select("id", "least.*"))
    many = chosen.count()
    space = fit(usable, many)
    kinds = "id long, label long, vector array<long>, cell int"
    held = cut(usable.select("id", "label", "vector").mapInArrow(space.place(False), kinds))
    placed = cut(chosen.mapInArrow(space.place(True), kinds))
    bounds = Bounds(space, placed)
    salts = max(1, -(-held.count() // ROWS))
    band = lambda lo, hi: placed.select("*", F.lit(0).alias("p"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
    near = search(space, bounds, band(-ANY, ANY), held, salts, positives, True)
    near = near.select(F.col("anchor_id").alias("id"), F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # low * s <= 100 * score <= high * s has no solution where s < 0
    asked = placed.join(near.where("positive_score >= 0"), "id").select("id", "p", "label", "vector", "cell", F.expr(f"({low} * positive_score + 99) div 100").alias("lo"), F.expr(f"{high} * positive_score div 100").alias("hi"))
    found = search(space, bounds, cut(asked), held, salts, negatives, False)
    named = near.select(F.col("id").alias("anchor_id"), "p", "positive_id", "positive_score")
    return found.join(named, ["anchor_id", "p"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
