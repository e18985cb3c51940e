"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's signature is TREES runs of DEPTH min-hash values. For each tree, all documents are put
in the order of their run (a global sort: range partitions, streams inside them, and the few rows at
their edges put together once more), so that the neighbours of a document are those that share its
longest prefixes. The depth adapts to the region: where at most REGION rows share a prefix of SHALLOW
values or more, all their pairs are candidates; where more do, a row's candidates are the smaller regions
further down and its direct neighbour. Candidates whose sketches or set sizes rule out the wanted
similarity go at once.

Links are confirmed on full shingle sets: first every document of a group of likely copies against the
group's least; then all candidates that join documents which no confirmed path connects yet. Regions
at SHALLOW that hold more rows, of several components, are then completed by their rarest shingles:
two sets of similarity 0.75 share one of their rarest quarter, at places that leave room for enough
others. Documents that share such a shingle meet the one of them that has the fewest rare shingles (an
original among its copies); then, those that are still apart, each other in blocks. No pair is left
out, whatever the region's size; a crowd that shares less than 0.75 has no shingle in common that early,
so it costs next to nothing. Documents with equal sets are one vertex. Components come from contracting
the graph of links, in DataFrame joins.

Sets are of 64-bit hashes of shingles; equal sets are told by a 128-bit digest of all of them.

Nulls and texts without words: n_shingles 0, linked with nothing. Shorter texts than five words have
their whole sequence as one shingle. A null id is linked with nothing and kept (component_id null).
Rows that repeat an id are one vertex. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .shingles import mix, packed, shingle_hashes, shingle_sets, steps, unpacked, word_hashes

TREES, DEPTH = 16, 8
HASHES = TREES * DEPTH
SHALLOW = 2
#: Rows with a common prefix up to which all pairs are candidates; in larger regions, direct neighbours are.
REGION = 12
#: Least share of agreeing one-bit values: 4.3 standard deviations under that of similarity 0.75.
AGREE = 96
#: Agreement that is as likely above similarity 0.75 as below: such candidates are confirmed first.
LIKELY = 112
#: Documents with a common rare shingle that a block should hold, about.
BLOCK = 512
#: Shingles of large regions are counted in 2 ** BUCKETS counters, 4 bytes each: all that is broadcast. The
#: counts order shingles, so fewer counters than shingles cost time, never links.
BUCKETS = 20
#: Documents with one shingle that go to one task when they meet the first of them, about, and the most tasks for one.
SPREAD, SALTS = 4096, 64
#: Large regions that a document must lie in to be completed: two of similarity 0.75 share fewer with a probability of 4e-5.
LEAST_REGIONS = 2
#: Partners in a block that a document is held against at a time, the likeliest first; the last takes all.
PARTNERS = (2, 1 << 30)
#: Rows that a range partition of the forest should hold, about.
ROWS = 200_000
#: Rows from the edges of partitions that a group should hold, about.
EDGES = 10_000

_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(1 << 31, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signatures(shingles: np.ndarray, counts: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Min-hash values of texts by their shingles: (texts, HASHES) uint32; texts without shingles have the largest value."""
    out = np.full((len(counts), HASHES), np.iinfo(np.uint32).max, np.uint32)
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    x = (shingles >> np.uint64(20)).astype(np.uint32)
    for at in range(0, len(x), block):
        # texts that have shingles in this block, and where each begins in it
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(ends, min(at + block, len(x)) - 1, "right")
        starts = np.maximum(np.r_[0, ends[:-1]][lo : hi + 1] - at, 0)
        part = x[at : at + block]
        held = np.empty((HASHES, hi + 1 - lo), np.uint32)
        work = np.empty(len(part), np.uint32)
        for k in range(HASHES):
            np.multiply(part, _MULTIPLY[k], out=work)
            np.add(work, _ADD[k], out=work)
            np.minimum.reduceat(work, starts, out=held[k])
        mine = some[lo : hi + 1]
        out[mine] = np.minimum(out[mine], held.T)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in steps(batch.column(1).cast(pa.large_binary())):
            words, counts, _ = word_hashes(texts)
            h, n = shingle_hashes(words, counts)
            owner = np.repeat(np.arange(len(texts)), n)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[first], owner[first]
            n = np.bincount(owner, minlength=len(texts))
            values = signatures(h, n)
            names = [blake2b(x.tobytes(), digest_size=16).digest() for x in np.split(h, np.cumsum(n)[:-1])]  # members are sorted
            low = (mix(values.astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2")
            bits = np.packbits(low.astype(np.uint8) & 1, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(texts)), pa.array(n.astype(np.int64)),
                    pa.array(names, pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()),
                ],
                names=["id", "n", "name", "signature", "bits"],
            )


_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _near(tree: np.ndarray, key: np.ndarray, bits: np.ndarray, n: np.ndarray, ids: np.ndarray, fresh: int, part: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Candidate pairs of rows in forest order, of which the first ``fresh`` were there before: a, b, agreeing bits."""
    head = np.ascontiguousarray(key[:, :SHALLOW])

    def shared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.where(tree[i] == tree[j], np.cumprod(key[i] == key[j], axis=1).sum(axis=1), 0)

    found = []
    for s in range(1, min(REGION, len(ids))):
        j = np.arange(max(fresh, s), len(ids))
        i = j - s
        ok = (tree[i] == tree[j]) & (head[i] == head[j]).all(axis=1)
        ok &= (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
        if part is not None:
            ok &= part[i] != part[j]
        i, j = i[ok], j[ok]
        if s > 1:  # no more than REGION rows share what the two do: the row so far back shares less
            over = np.zeros(len(j), np.int64)
            deep = j >= REGION
            over[deep] = shared(j[deep] - REGION, j[deep])
            ok = over < shared(i, j)
            i, j = i[ok], j[ok]
        agree = HASHES - _POPULATION[bits[i] ^ bits[j]].sum(axis=1, dtype=np.int64)
        ok = agree >= AGREE
        i, j, agree = i[ok], j[ok], agree[ok]
        found.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), agree))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    size = batch.num_rows
    raw = lambda c, w: np.frombuffer(b"".join(x.as_py() for x in c), np.uint8).reshape(size, w)
    key = raw(batch.column("key"), 2 * DEPTH).copy().view(">u2").astype(np.uint16)
    return batch.column("tree").to_numpy().astype(np.int64), key, raw(batch.column("bits"), HASHES // 8), batch.column("n").to_numpy(), batch.column("id").to_numpy()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates inside one range partition, with the rows at its edges (kind 1)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: tuple[np.ndarray, ...] | None = None
    names = ["kind", "a", "b", "agree", "part", "tree", "key", "bits", "n"]

    def out(pairs=None, rows=None):
        if pairs is not None:
            k = len(pairs[0])
            cols = [np.zeros(k, np.int8), *pairs, np.full(k, part), np.zeros(k, np.int64), [None] * k, [None] * k, np.zeros(k, np.int64)]
        else:
            tree, key, bits, n, ids = rows
            k = len(ids)
            cols = [np.ones(k, np.int8), ids, ids, np.zeros(k, np.int64), np.full(k, part), tree, [x.astype(">u2").tobytes() for x in key], [x.tobytes() for x in bits], n]
        kinds = [pa.int8(), *[pa.int64()] * 5, pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)

    first: tuple[np.ndarray, ...] | None = None
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _columns(batch)
        rows = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        fresh = len(rows[0]) - len(new[0])
        yield out(pairs=_near(*rows, fresh))
        total += len(new[0])
        if first is None or len(first[0]) < REGION:
            first = tuple(x[:REGION] for x in (new if first is None else tuple(np.concatenate(y) for y in zip(first, new, strict=True))))
        held = tuple(x[-REGION:] for x in rows)
    if held is not None:
        yield out(rows=first)
        keep = min(REGION, total - len(first[0]))
        if keep > 0:
            yield out(rows=tuple(x[-keep:] for x in held))


def _edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates between range partitions, of rows at their edges; rows that share SHALLOW values come together."""
    pdf = pdf.sort_values(["tree", "key", "a"], kind="stable")
    key = np.frombuffer(b"".join(pdf["key"]), ">u2").reshape(len(pdf), DEPTH).astype(np.uint16)
    bits = np.frombuffer(b"".join(pdf["bits"]), np.uint8).reshape(len(pdf), HASHES // 8)
    a, b, agree = _near(pdf["tree"].to_numpy(), key, bits, pdf["n"].to_numpy(), pdf["a"].to_numpy(), 0, pdf["part"].to_numpy())
    return pd.DataFrame({"a": a, "b": b, "agree": agree})


def candidates(reps: DataFrame, rows: int) -> DataFrame:
    """Candidate pairs (a < b, agree) of vertices (id, n, signature, bits)."""
    forest = reps.select("id", "n", "bits", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    forest = forest.select("tree", F.substring("signature", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("key"), "id", "n", "bits")
    parts = max(1, -(-rows * TREES // ROWS))
    found = cut(
        forest.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
        .mapInArrow(_stream, "kind byte, a long, b long, agree long, part long, tree long, key binary, bits binary, n long")
    )
    inside = found.where("kind = 0").select("a", "b", "agree")
    groups = max(1, parts * 2 * REGION // EDGES)
    edges = found.where("kind = 1").select("a", "part", "tree", "key", "bits", "n", F.pmod(F.xxhash64("tree", F.substring("key", 1, 2 * SHALLOW)), F.lit(groups)).alias("group"))
    across = edges.groupBy("group").applyInPandas(_edges, "a long, b long, agree long")
    return inside.unionByName(across).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def components(vertices: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """Least reachable id of each vertex (id, label), by contraction.

    In each round every vertex points to the neighbour of most neighbours (of equal ones, of least hash),
    itself included, which settles stars at once and makes short chains even of long paths; pointers are
    doubled twice, and the graph shrinks to what its pointers are joined by. The rounds' maps are put
    together from the last one back; then a component's least id is its label.
    """
    open_ = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    maps: list[DataFrame] = []
    for turn in range(most):
        if not open_.limit(1).count():
            break
        order = lambda c, many: F.struct((-F.col(many)).alias("many"), F.xxhash64(c, F.lit(turn)).alias("hash"), F.col(c).alias("id"))
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        many = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("of_b"))
        near = both.join(many, "b").groupBy("a").agg(F.min(order("b", "of_b")).alias("near"), F.count("*").alias("of_a"))
        up = cut(near.select(F.col("a").alias("id"), F.least(order("a", "of_a"), F.col("near"))["id"].alias("up")))
        for _ in range(2):
            up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up"))
        maps.append(cut(up))
        side = lambda c: maps[-1].select(F.col("id").alias(c), F.col("up").alias(f"up_{c}"))
        ends = open_.join(side("a"), "a").join(side("b"), "b").where("up_a <> up_b")
        open_ = cut(ends.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
    else:
        raise RuntimeError("components didn't settle")
    if not maps:
        return vertices.select("id", F.col("id").alias("label"))
    whole = maps.pop()
    while maps:
        later = whole.select(F.col("id").alias("up"), F.col("up").alias("last"))
        whole = cut(maps.pop().join(later, "up", "left").select("id", F.coalesce("last", "up").alias("up")))
    least = whole.groupBy("up").agg(F.min("id").alias("label"))
    labels = whole.join(least, "up").select("id", "label")
    return cut(vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label")))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: whole components are joined by their labels, few beside their members."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    between = links.join(side("a"), "a").join(side("b"), "b").where("la <> lb")
    edges = cut(between.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if not edges.limit(1).count():
        return labels
    moved = components(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges).where("label < id")
    moved = moved.select(F.col("id").alias("label"), F.col("label").alias("to"))
    return cut(labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets are similar enough."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        good = np.zeros(len(a), bool)
        for at, texts in unpacked(right):
            lefts, place = [], {}
            for i in range(at, at + len(texts)):  # a text that many are held against is cut up once
                if int(a[i]) not in place:
                    place[int(a[i])] = len(lefts)
                    lefts.append(unpack.decompress(left[i].as_py()))
            left_sets, right_sets = shingle_sets(lefts), shingle_sets(texts)
            for i, y in zip(range(at, at + len(texts)), right_sets, strict=True):
                x = left_sets[place[int(a[i])]]
                both = len(x) + len(y) - len(np.union1d(x, y))
                good[i] = both > 0 and 100 * both >= 75 * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose packed texts (id, text) are similar."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def dense(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids in LEAST_REGIONS or more regions at SHALLOW that are larger than REGION and that several components have."""
    forest = reps.join(labels, "id").select("id", "label", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    forest = forest.select("id", "label", "tree", F.substring("signature", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * SHALLOW)).alias("head"))
    regions = forest.groupBy("tree", "head").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    large = regions.where((F.col("size") > REGION) & (F.col("low") < F.col("high"))).select("tree", "head")
    return forest.join(large, ["tree", "head"], "left_semi").groupBy("id").count().where(F.col("count") >= LEAST_REGIONS).select("id")


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket of shingles in a batch: how many, and the least and largest label of their documents."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        for at, texts in unpacked(batch.column("text")):
            sets = shingle_sets(texts)
            bucket = _bucket(np.concatenate(sets))
            of = np.repeat(label[at : at + len(texts)], [len(x) for x in sets])
            order = np.argsort(bucket, kind="stable")
            bucket, of = bucket[order], of[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
            if len(first):
                cols = [bucket[first], np.diff(np.r_[first, len(bucket)]), np.minimum.reduceat(of, first), np.maximum.reduceat(of, first)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "m", "low", "high"])


_RARE = ["token", "spread", "id", "n", "place", "label", "hi", "lo"]


def _rarest(table):
    """Each document's rarest quarter of shingles, and one more: those alone that other components may have.

    Shingles of one component come first in the order, then others by their counter and hash. ``place`` counts from 1.
    """

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = table.value
        for batch in batches:
            ids, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            bits = batch.column("bits")
            for at, texts in unpacked(batch.column("text")):
                out = []
                for k, x in enumerate(shingle_sets(texts)):
                    n = len(x)
                    c = count[_bucket(x)]
                    crossing = np.flatnonzero(c)
                    first, most = n - len(crossing), n - -(-3 * n // 4) + 1
                    if first >= most:
                        continue
                    crossing = crossing[np.lexsort((x[crossing], c[crossing]))][: most - first]
                    place = first + 1 + np.arange(len(crossing))
                    hi, lo = np.frombuffer(bits[at + k].as_py(), np.int64)
                    size = len(crossing)
                    spread = np.minimum(SALTS, 1 + c[crossing] // SPREAD).astype(np.int64)
                    out.append((x[crossing].view(np.int64), spread, np.full(size, ids[at + k]), np.full(size, n), place, np.full(size, label[at + k]), np.full(size, hi), np.full(size, lo)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=_RARE)

    return rarest


def rarest(texts: DataFrame) -> DataFrame:
    """Rarest shingles of texts (id, text, bits, label); see ``_rarest``."""
    spark = texts.sparkSession
    counted = texts.select("label", "text").mapInArrow(_counted, "bucket long, m long, low long, high long")
    counted = counted.groupBy("bucket").agg(F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    held = counted.select(F.col("bucket").cast("int"), F.least("m", F.lit((1 << 31) - 1)).cast("int").alias("m")).toArrow()  # 2 ** BUCKETS rows at most
    count = np.zeros(1 << BUCKETS, np.int32)
    count[held.column("bucket").to_numpy()] = held.column("m").to_numpy()
    kinds = ", ".join(f"{c} long" for c in _RARE)
    return cut(texts.select("id", "text", "bits", "label").mapInArrow(_rarest(spark.sparkContext.broadcast(count)), kinds))


def with_first(rows: DataFrame) -> DataFrame:
    """Candidates (a, b): documents and the first by rank of those that share a rare shingle, the two likeliest for each."""
    about = F.struct((F.col("place") / F.col("n")).alias("rank"), *_RARE[2:])
    firsts = rows.groupBy("token", "spread").agg(F.min(about).alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    firsts = firsts.select("token", "f", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("id"), "spread")).join(firsts, ["token", "salt"]).where(F.col("label") != F.col("f.label"))
    n, m = F.col("n"), F.col("f.n")
    room = 7 * (1 + F.least(n - F.col("place"), m - F.col("f.place"))) >= 3 * (n + m)
    agree = HASHES - F.bit_count(F.col("hi").bitwiseXOR(F.col("f.hi"))) - F.bit_count(F.col("lo").bitwiseXOR(F.col("f.lo")))
    met = met.where((4 * F.least(n, m) >= 3 * F.greatest(n, m)) & room).select("id", F.col("f.id").alias("first"), agree.alias("agree")).where(F.col("agree") >= AGREE)
    best = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("agree", "first")), False), 1, 2).alias("of"))  # by a document's own shingles
    return best.select("id", F.explode("of.first").alias("first")).select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()


def _of_blocks(here: np.ndarray, there: np.ndarray, same: bool, n, place, label, hi, lo, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of two blocks that may be links between components, the ``most`` likeliest of each document."""
    p, q = n[here][:, None], n[there][None]
    room = 7 * (1 + np.minimum(p - place[here][:, None], q - place[there][None])) >= 3 * (p + q)
    ok = room & (4 * np.minimum(p, q) >= 3 * np.maximum(p, q)) & (label[here][:, None] != label[there][None])
    if not ok.any():
        return here[:0], there[:0]
    agree = HASHES - np.bitwise_count(hi[here][:, None] ^ hi[there][None]).astype(np.int64) - np.bitwise_count(lo[here][:, None] ^ lo[there][None])
    ok &= agree >= AGREE
    if most < max(ok.shape):
        score = np.where(ok, agree, -1)
        rank = lambda axis: np.argsort(np.argsort(-score, axis=axis, kind="stable"), axis=axis, kind="stable")
        ok &= np.minimum(rank(0), rank(1)) < most
    i, j = np.nonzero(np.triu(ok) if same else ok)
    return here[i], there[j]


def _propose(most: int):
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "p", "q", "block", "id", "n", "place", "label", "hi", "lo"]

        def pairs(cols: list[np.ndarray], end: int) -> pa.RecordBatch:
            token, p, q, block, ids, n, place, label, hi, lo = (c[:end] for c in cols)
            first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])][:end])
            found = []
            for at, to in zip(first, np.r_[first, end][1:], strict=True):  # none where a pair of blocks fills all batches so far
                mine = np.arange(at, to)
                i, j = _of_blocks(mine[block[at:to] == p[at]], mine[block[at:to] == q[at]], p[at] == q[at], n, place, label, hi, lo, most)
                found.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
            out = np.unique(np.concatenate([np.stack(f, 1) for f in found]), axis=0) if found else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out.T], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in names]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            open_ = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            end = int(np.argmax(open_))  # the last pair of blocks may go on
            yield pairs(held, end)
            held = [c[end:] for c in held]
        if held is not None:
            yield pairs(held, len(held[0]))

    return propose


def in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """Candidates (a, b) of documents that share a rare shingle and aren't connected: all but the members of the largest
    component under the shingle meet each other and them, in pairs of blocks."""
    shares = rows.groupBy("token", "label").agg(F.count("*").alias("m"), F.max((7 * (F.col("place") - 1) <= F.col("n")).cast("int")).alias("early"))
    tokens = shares.groupBy("token").agg(F.sum("m").alias("size"), F.max(F.struct("m", "label")).alias("top"), F.max("early").alias("early"))
    tokens = tokens.where((F.col("size") > F.col("top.m")) & (F.col("early") == 1))  # the smaller set has it in its first seventh
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    tokens = tokens.select("token", F.col("top.label").alias("largest"), blocks(F.col("size") - F.col("top.m")).alias("opened"), blocks(F.col("top.m")).alias("closed"))
    salt = lambda m: F.pmod(F.xxhash64("id"), m).cast("int")
    block = F.when(F.col("label") == F.col("largest"), F.col("opened") + salt(F.col("closed"))).otherwise(salt(F.col("opened")))
    placed = rows.join(tokens, "token").select(*_RARE, "opened", (F.col("opened") + F.col("closed")).alias("blocks"), block.alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("block") < F.col("opened"), F.col("blocks")).otherwise(F.col("opened")) - 1)).alias("other")
    met = placed.select(*_RARE, "block", other).select(*_RARE, "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    return met.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q").mapInArrow(_propose(most), "a long, b long").distinct()


def settle(reps: DataFrame, labels: DataFrame, given: DataFrame, checked: DataFrame) -> DataFrame:
    """Labels after large regions are completed by rare shingles. ``checked``: pairs that are settled."""
    ids = cut(dense(reps, labels))
    if not ids.limit(1).count():
        return labels
    texts = given.join(ids, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(packed, "id long, text binary")
    texts = cut(texts.join(reps.select("id", "bits"), "id"))
    for most in (0, *PARTNERS):
        rows = rarest(texts.join(labels, "id"))
        proposed = in_blocks(rows, most) if most else with_first(rows)
        pairs = cut(proposed.join(checked, ["a", "b"], "left_anti"))
        if pairs.limit(1).count():
            labels = joined(labels, cut(confirm(pairs, texts.select("id", "text"))))
            checked = checked.unionByName(pairs)
    return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    with small_batches(docs.sparkSession):
        return _near_dedup(docs, id_col, text_col)


def _near_dedup(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sketched = cut(given.mapInArrow(_sketch, "id long, n long, name binary, signature binary, bits binary"))
    # one vertex for each distinct set
    classes = sketched.where("n > 0 and id is not null").groupBy("name", "n").agg(F.min("id").alias("rep"))
    reps = cut(sketched.where("n > 0").join(classes.select(F.col("rep").alias("id"), F.col("name").alias("of")), "id").where("name = of").drop("of", "name").dropDuplicates(["id"]))
    pairs = cut(candidates(reps, reps.count()))

    vertices = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = cut(given.join(vertices, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(packed, "id long, text binary"))
    # each against the least of its group of likely copies
    groups = components(vertices, pairs.where(F.col("agree") >= LIKELY))
    stars = cut(groups.where("label < id").select(F.col("label").alias("a"), F.col("id").alias("b")))
    labels = joined(vertices.select("id", F.col("id").alias("label")), cut(confirm(stars, texts)))
    # all candidates that join documents which no confirmed path connects
    side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    apart = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("label_a <> label_b")
    open_ = cut(apart.select("a", "b").join(stars, ["a", "b"], "left_anti"))
    labels = joined(labels, cut(confirm(open_, texts)))
    every = cut(reps.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    labels = settle(reps, every, given, pairs.select("a", "b"))
    members = sketched.select("id", F.col("n").alias("n_shingles"), "name").join(classes.withColumnRenamed("n", "n_shingles"), ["name", "n_shingles"], "left")
    members = members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "rep", "id"))
    return members.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
