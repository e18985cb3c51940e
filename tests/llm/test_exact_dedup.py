import hashlib

import numpy as np

from zonestat.llm.exact_dedup import CountingQuotientFilter, exact_dedup


def rows(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def test_filters_merge_losslessly():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 500, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    parts = [CountingQuotientFilter.of(60, p) for p in np.split(fps, 8)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(CountingQuotientFilter.from_row(60, *p.to_row()))
    want, counts = np.unique(fps & np.uint64((1 << 60) - 1), return_counts=True)
    assert np.array_equal(whole.keys(), want) and np.array_equal(whole.counts, counts)
    empty = CountingQuotientFilter.of(60, np.zeros(0, np.uint64))
    assert np.array_equal(empty.merge(whole).keys(), want)


def test_copies_nulls_and_case(docs_of, clash):
    docs = docs_of(["A b", "a B", None, "", "É", "é", "a  b", "x" * 200_000, "X" * 200_000])
    got = exact_dedup(clash(docs))
    assert rows(got) == [(0, 1, 2, False), (1, 1, 2, True), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 8, 2, False), (8, 8, 2, True)]
    sha = {r["doc_id"]: r["text_sha256"] for r in got.collect()}
    assert sha[2] == hashlib.sha256(b"").hexdigest() and sha[4] == hashlib.sha256("É".encode()).hexdigest()


def test_repeats_and_empty_table(docs_of):
    docs = docs_of(["t", "t"])
    assert rows(exact_dedup(docs.union(docs))) == [(0, 1, 4, False)] * 2 + [(1, 1, 4, True)] * 2
    assert exact_dedup(docs.limit(0)).count() == 0
    null = docs_of([(None, "q", None, None)])
    assert [(r["kept"], r["group_size"]) for r in exact_dedup(null).collect()] == [(True, 1)]


def test_null_ids_beside_copies_and_many_texts(docs_of):
    import random

    rng = random.Random(8)
    given = [(None if k % 50 == 49 else k, rng.choice("aAbB") * rng.randrange(1, 90) + str(rng.randrange(40)), None, None) for k in range(3000)]
    want = {}
    for k, t, *_ in given:
        size, keep = want.get(t.lower(), (0, None))
        want[t.lower()] = (size + 1, max(x for x in (k, keep, -1) if x is not None))
    texts = {k: t for k, t, *_ in given if k is not None}
    got = exact_dedup(docs_of(given).repartition(7)).collect()
    assert len(got) == 3000
    for r in got:
        if r["doc_id"] is not None:
            size, keep = want[texts[r["doc_id"]].lower()]
            assert (r["group_size"], r["keep_id"], r["kept"]) == (size, keep, r["doc_id"] == keep)
        else:
            assert not r["kept"] or r["keep_id"] is None
