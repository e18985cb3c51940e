"""The trie of conversation prefixes, as preorder intervals.

Each distinct sequence of first turns (role, text) is a node. Its key is its depth and the exclusive-or of its
turns' hashes (128 bits over role, text and place), which a running total over all turns gives: no conversation is
ever put together in one place. Distinct nodes are sorted by their paths, so that every subtree is one interval:
``position`` is a node's rank and ``subtree_end`` the first rank behind its subtree, which a row of each leaf's
conversation brings up to the nodes above it. Leaves and savings of a subtree are then differences of two running
totals over that order.

A path has one part for each ancestor where conversations part, not for each turn, and the node's depth: nodes
between two partings follow each other. So a path is no longer than the partings above it.

Turns come in order of ``turn`` (null first), those that tie in order of role and text. Null roles and texts are
empty. Rows without a conv_id belong to no conversation and are left out; rows that repeat are turns of their own.
Other columns are ignored. Without conversations there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .common import cut, shuffle_partitions

KEY = ["depth", "k1", "k2"]
#: Ids that are put together as text before they meet the others of their node.
IDS = 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, role, text) of all turns."""
    plain = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    rows = running(plain, ["conv_id", "turn", "role", "text"])
    first = rows.groupBy("conv_id").agg(F.min("running_row").alias("first"))
    return rows.join(first, "conv_id").select("conv_id", (F.col("running_row") - F.col("first") + 1).alias("place"), "role", "text")


def regrafted(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns with conversations' beginnings exchanged, and all conversations (conv_id).

    A conversation c gets the first h turns of conversation c - c % block instead of its own first h, where h is
    crc32(c) % most: conversations of a block come to share beginnings.
    """
    ids = turns.select("conv_id").distinct()
    cuts = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    sizes = heads.groupBy("base").agg(F.count("*").alias("n"))
    cuts = cuts.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0))))
    own = turns.join(cuts.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    grafted = heads.join(cuts.select("conv_id", "base", "h"), "base").where("place <= h").select("conv_id", "place", "role", "text")
    return own.unionByName(grafted), ids


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of IDS ids of one node, as text; rows come in order."""
    names = ["position", "first", "ids"]
    node, held = None, []

    def out():
        return [node], [held[0]], [",".join(map(str, held))]

    for batch in batches:
        rows: tuple[list, list, list] = ([], [], [])
        for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (at != node or len(held) >= IDS):
                for r, x in zip(rows, out(), strict=True):
                    r += x
                held = []
            node = at
            held.append(conv)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(out()[0], pa.int64()), pa.array(out()[1], pa.int64()), pa.array(out()[2], pa.string())], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs in order: only the state of one digest is held."""
    node, digest = None, None
    for batch in batches:
        done: tuple[list, list] = ([], [])
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest is not None and at != node:
                done[0].append(node)
                done[1].append(digest.hexdigest())
                digest = None
            node, digest, lead = at, digest or hashlib.sha256(), "," if digest is not None else ""
            digest.update((lead + ids).encode())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.string())], names=["position", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], names=["position", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(position, ends_sha256) of (position, conv_id): ids in ascending order, joined by commas."""
    parts = shuffle_partitions(ends.sparkSession)
    runs = ends.select("position", "conv_id").repartitionByRange(parts, "position", "conv_id").sortWithinPartitions("position", "conv_id").mapInArrow(_listed, "position long, first long, ids string")
    return runs.repartition(parts, "position").sortWithinPartitions("position", "first").mapInArrow(_hashed, "position long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of conversations ``ids`` (conv_id) with ``turns`` (conv_id, place from 1, role, text).

    Returns conv_id (least member), depth, parent_conv_id, n_convs, n_ends, n_children, position, subtree_end, n_leaves,
    saved_tokens (over the subtree: members beyond the first times the last text's characters), ends_sha256.
    """
    hashed = turns.select("conv_id", "place", F.char_length("text").cast("long").alias("chars"), *[F.xxhash64(F.lit(n), "place", "role", "text").alias(f"h{n}") for n in (1, 2)])
    chained = running(hashed, ["conv_id", "place"], xors=["h1", "h2"])
    before = F.min(F.struct("place", *[F.col(f"running_h{n}").bitwiseXOR(F.col(f"h{n}")).alias(f"b{n}") for n in (1, 2)])).alias("b")
    chained = chained.join(chained.groupBy("conv_id").agg(before), "conv_id")
    key = lambda n: F.col(f"running_h{n}").bitwiseXOR(F.col(f"b.b{n}"))
    deep = chained.select("conv_id", F.col("place").alias("depth"), key(1).alias("k1"), key(2).alias("k2"), *[key(n).bitwiseXOR(F.col(f"h{n}")).alias(f"p{n}") for n in (1, 2)], "chars")
    zero = F.lit(0).cast("long")
    roots = ids.select("conv_id", *[zero.alias(c) for c in (*KEY, "p1", "p2", "chars")])
    rows = cut(deep.unionByName(roots))

    nodes = rows.groupBy(*KEY, "p1", "p2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"))
    above = lambda df: df.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    nodes = cut(nodes.join(above(nodes.where("depth > 0")).groupBy(*KEY).agg(F.count("*").alias("n_children")), KEY, "left").fillna(0, ["n_children"]))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("parted"))
    nodes = cut(nodes.join(parents, ["depth", "p1", "p2"], "left").withColumn("parted", F.coalesce("parted", F.lit(False))))

    # paths: where conversations part, the key of the way taken; then the depth
    ways = rows.join(nodes.where("parted").select(*KEY), KEY).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("ways"))
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    way = lambda w: F.concat(F.lit("1"), digits(w["k1"]), digits(w["k2"]))
    taken = F.filter(F.col("ways"), lambda w: w["depth"] <= F.col("depth"))
    path = F.concat(F.coalesce(F.array_join(F.transform(taken, way), ""), F.lit("")), F.lit("0"), digits("depth"))
    leaf = (F.col("n_children") == 0).cast("long")
    placed = nodes.join(ways, "conv_id", "left").select(*nodes.columns, path.alias("path"), leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    placed = running(placed, ["path"], sums=["leaf", "saved"])
    placed = cut(placed.withColumn("position", F.col("running_row") - 1).drop("path", "running_row", "p1", "p2", "parted"))

    # each leaf's totals, brought up by one conversation that ends there; a subtree's last leaf has the largest
    leaves = placed.where("leaf = 1").select("conv_id", F.struct("position", "running_leaf", "running_saved").alias("at"))
    last = rows.join(leaves, "conv_id").groupBy(*KEY).agg(F.max("at").alias("last"))
    ends = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end")).select("conv_id", "end.*")
    ends = cut(ends.join(placed.select(*KEY, "position"), KEY).select("position", "conv_id"))
    counts = ends.groupBy("position").agg(F.count("*").alias("n_ends"))
    out = placed.join(last, KEY).join(ends_digests(ends), "position", "left").join(counts, "position", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"), "n_children", "position", (F.col("last.position") + 1).alias("subtree_end"),
        (F.col("last.running_leaf") - F.col("running_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("last.running_saved") - F.col("running_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
