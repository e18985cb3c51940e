"""Prefix tries, SimHash components and hard negatives against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from zonestat.llm import hard_negatives as H
from zonestat.llm import prefix_trie as T
from zonestat.llm import simhash as S
from zonestat.operators import running as R

# prefix tries


def regrafted(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def trie(convs):
    """Rows of all nodes: conv_id, depth, parent's conv_id, members, children, leaves, saved tokens, digest of ends."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(who) - 1) * (len(path[-1][1]) if path else 0)
    rows = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(path)))
        rows.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rng):
    rows = []
    for c in [*range(0, 24), 100, 101, 107, 203, 250, -5, -250, 1234567]:
        for turn in range(rng.integers(1, 9)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], f"say {rng.integers(0, 2)}"))
    rows += [(300, None, None, None), (300, 2, "user", None), (300, 2, "user", None), (300, 1, "user", ""), (301, 0, "user", "long " * 50_000), (302, 0, "user", "é\U0001f600x"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 470) for t in range(3)]  # one conversation many times
    rows += [(900, t, "user", f"deep {t}") for t in range(300)] + [(901, t, "user", f"deep {t}" if t < 290 else "other") for t in range(300)]
    return rows


def test_trie(spark, monkeypatch):
    rows = conversations(np.random.default_rng(3))
    monkeypatch.setattr(T, "IDS", 7)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS depth", "3 AS k1", "4 AS position", "5 AS h")
    nodes = T.prefix_trie(*T.regrafted(T.ordered_turns(df.repartition(5))))
    got = nodes.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=lambda r: r[:2]) == trie(regrafted(rows))
    by = {r["position"]: r for r in got}
    assert sorted(by) == list(range(len(got))) and by[0]["depth"] == 0 and by[0]["subtree_end"] == len(got)
    for r in got:  # preorder: a subtree is one interval of deeper nodes
        inside = [by[k] for k in range(r["position"] + 1, r["subtree_end"])]
        assert all(x["depth"] > r["depth"] for x in inside) and (r["subtree_end"] == len(got) or by[r["subtree_end"]]["depth"] <= r["depth"])
        assert sum(x["n_ends"] for x in [r, *inside]) == r["n_convs"]


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.prefix_trie(*T.regrafted(T.ordered_turns(none))).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x")], none.schema)
    assert T.prefix_trie(*T.regrafted(T.ordered_turns(lost))).count() == 0


def test_running(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 5)), k, int(rng.integers(-9, 9)), int(rng.integers(-(1 << 63), 1 << 63))) for k in range(500)]
    got = R.running(spark.createDataFrame(rows, "a long, b long, s long, x long").repartition(7), ["a", "b"], ["s"], ["x"]).collect()
    total, mixed = 0, 0
    for k, (want, r) in enumerate(zip(sorted(rows), sorted(got, key=lambda r: (r["a"], r["b"])), strict=True)):
        total, mixed = total + want[2], mixed ^ want[3]
        assert (r["running_row"], r["running_s"], r["running_x"]) == (k + 1, total, mixed)


# SimHash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Least number of each print's component, by all pairs."""
    label = np.arange(len(prints))
    p = np.array(prints, np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 3
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_fingerprints(spark, docs_of, clash):
    long = " ".join(f"w{k % 977}" for k in range(40_000))
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "A\x0bb\x0cc d", "à É b\xa0c d e", "x y z " * 40, long]
    got = {r["doc_id"]: r["fingerprint"] for r in S.simhash_dedup(clash(docs_of(texts))).collect()}
    assert got == {k: f"{fingerprint(t):016x}" for k, t in enumerate(texts)}


def test_long_texts_in_pieces():
    text = (" ".join(f"Word{k * k % 1009}" for k in range(3000)) + "  \n tail").encode()
    whole = [h for run in S.shingle_hashes(text) for h in run]
    for piece in (1, 7, 64, 5000):
        assert [h for run in S.shingle_hashes(text, piece) for h in run] == whole
    assert len(whole) == len(text.split()) - 2


def planted_prints(rng):
    prints = [int(x) for x in rng.integers(0, 1 << 63, 150)] + [0, 0, (1 << 64) - 1]
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    for k in range(60):
        prints.append(flip(prints[k], 1 + k % 5))
    at = prints[0]
    for k in range(40):  # a chain of links of three bits
        at = flip(at, 3)
        prints.append(at)
    hub = int(rng.integers(0, 1 << 63))
    prints += [hub, *[flip(hub, 3) for _ in range(150)], *[flip(hub, 2) for _ in range(50)]]
    return prints


def test_components_by_force(spark):
    prints = planted_prints(np.random.default_rng(5))
    signed = [S._signed(p) for p in prints]
    want = components(prints)
    labels = {r["id"]: r["label"] for r in S.simhash_components(spark.createDataFrame([(p,) for p in set(signed)], "id long")).collect()}
    groups = defaultdict(set)
    for p, w in zip(signed, want, strict=True):
        groups[int(w)].add(labels[p])
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_links_of_three_bits_alone(spark):
    """Every link of three bits joins, whichever bits they are."""
    rng = np.random.default_rng(6)
    ids = []
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        ids += [a, a ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False))]
    labels = {r["id"]: r["label"] for r in S.simhash_components(spark.createDataFrame([(S._signed(p),) for p in ids], "id long")).collect()}
    assert all(labels[S._signed(a)] == labels[S._signed(b)] for a, b in zip(ids[::2], ids[1::2], strict=True))
    assert len(set(labels.values())) == 300


def test_simhash_rows(spark, docs_of):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(9, base, "en", "s"), (4, base.upper(), "en", "s"), (7, base + " more", "en", "s"), (7, "quite another text", "en", "s"), (None, base, "en", "s"), (None, "nobody else has this", "en", "s"), (3, None, "en", "s"), (5, "", None, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.simhash_dedup(docs_of(rows)).collect()), key=str)
    want = components([fingerprint(r[1]) for r in rows])
    least = defaultdict(list)
    for r, w in zip(rows, want, strict=True):
        least[int(w)].append(r[0])
    known = lambda ids: min((i for i in ids if i is not None), default=None)
    assert got == sorted(((r[0], known(least[int(w)])) for r, w in zip(rows, want, strict=True)), key=str)
    assert S.simhash_dedup(docs_of([])).count() == 0


# hard negatives


def mined(rows):
    """All by force: rows (id, label, vector of integers or None)."""
    rows = [r for r in rows if None not in r]
    out = []
    anchors = {}
    for i, label, v in sorted(rows):
        if i % 100 == 0:
            anchors.setdefault(i, (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (label, v) in anchors.items():
        scored = sorted(((-dot(v, w), i, lab == label) for i, lab, w in rows), key=lambda x: x[:2])
        for p, (pos, j, _) in enumerate([s for s in scored if s[2] and s[1] != a][:5]):
            fits = [(s, i) for s, i, same in scored if not same and -30 * pos <= -100 * s <= -90 * pos]
            out += [(a, j, k + 1, i, -pos, -s) for k, (s, i) in enumerate(fits[:10])]
    return sorted(out)


def vectors(rng, n=1500, width=6):
    centres = rng.normal(0, 300, (12, width))
    rows = []
    for k in range(n):
        c = k % 12
        rows.append((k, c // 3, [int(x) for x in centres[c] + rng.normal(0, 60, width)]))
    rows += [(n, 1, None), (n + 1, None, rows[0][2]), (None, 1, rows[0][2]), (n + 2, 2, []), (n + 3, 2, [400]), (n + 4, 0, [0] * width)]
    rows += [(n + 5 + k, 3, rows[7][2]) for k in range(200)]  # one vector many times
    rows += [(200, 2, rows[5][2]), (201, 1, rows[5][2]), (201, 1, rows[5][2])]  # repeated ids
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many cells, chunks and salts; and few comparisons at a time
        for name, value in (("EACH", 1), ("ANCHORS", 2), ("ROWS", 300), ("CELLS", 50)):
            monkeypatch.setattr(H, name, value)
    rows = vectors(np.random.default_rng(8))
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>").selectExpr("*", "1 AS cell", "2 AS p", "3 AS salt", "4 AS score")
    got = H.hard_negatives(df, F.col("id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == mined(rows) and len(got) > 100


def test_rows_go_only_where_they_may_count(spark, monkeypatch):
    """With cells far apart most rows stay where they are, and results stay whole."""
    monkeypatch.setattr(H, "EACH", 1)
    rng = np.random.default_rng(9)
    centres = np.eye(8) * 4000
    rows = [(k, k // 8 % 2, [int(x) for x in centres[k % 8] + rng.normal(0, 5, 8)]) for k in range(1200)]
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>")
    placed = df.where("id % 100 = 0")
    space = H.fit(df, 12)
    kinds = "id long, label long, vector array<long>, cell int"
    bounds = H.Bounds(space, placed.mapInArrow(space.place(True), kinds))
    held = df.mapInArrow(space.place(False), kinds)
    accepts = {c: (15_000_000, 1 << 62) for c in np.flatnonzero(bounds.chunks).tolist()}
    sent = held.mapInArrow(bounds.route(space, accepts), "id long, label long, vector array<long>, cell int, chunk int").count()
    assert sent < 0.3 * len(rows) * len(accepts)
    got = H.hard_negatives(df, F.col("id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == mined(rows)


def test_integer_vectors(spark):
    rows = [(1, [0.1, -0.1]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf")]), (6, []), (7, [-0.00390625, 0.00390624])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r[0]: r[1] for r in df.select("id", H.integer_vectors(df, "v")).collect()}
    assert got == {1: [25, -26], 2: None, 3: None, 4: None, 5: None, 6: [], 7: [-1, 0]}


def test_no_anchors(spark):
    df = spark.createDataFrame([(1, 2, [3, 4])], "id long, label long, vector array<long>")
    assert H.hard_negatives(df, F.col("id") % 100 == 0).count() == 0
    assert H.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
