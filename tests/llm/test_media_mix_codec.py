"""Media chunks, source mixes and SentencePiece ids: exact round trips and stated rules."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from zonestat.llm import media_chunks as M
from zonestat.llm.mixing import mix
from zonestat.llm.piece_codec import Codec, encode_decode


def test_gear_hash_is_the_rolling_hash():
    data = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(M.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert M.gear_hash(data).tolist() == want


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 256, 200_000).astype(np.uint8).tobytes()
    (_, first), (_, second) = M.chunked([body, b"some bytes in front" + body])
    assert b"".join(first) == M.payload(body)
    assert len(set(first) & set(second)) > len(first) // 2
    assert max(map(len, first)) <= M.MOST + M.LEAST
    (_, alone), = M.chunked([body])
    assert alone == first


def test_media_round_trip(docs_of, clash):
    rng = random.Random(0)
    texts = ["abc", "abc", None, "", "é" * 500, "x" * 100_000, "".join(chr(rng.randint(97, 122)) for _ in range(50_000)), "y" * 576]
    got = {r["doc_id"]: r for r in M.media_column(clash(docs_of(texts))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(p[-32:]) and r["media_bytes"] > 0 and len(r["media_sha256"]) == 64
    assert got[0].asDict() | {"doc_id": 1} == got[1].asDict()
    assert got[2]["media_sha256"] == got[3]["media_sha256"]
    docs = docs_of(texts)
    assert M.media_column(docs.union(docs)).count() == 2 * len(texts)
    assert M.media_column(docs.limit(0)).count() == 0


def test_damage_is_found():
    import zstandard

    chunks = [b"a" * 3000, b"b" * 100]
    media = M.container([hashlib.sha256(c).digest() for c in chunks], [zstandard.compress(c) for c in chunks])
    assert M.read_back(media) == b"".join(chunks)
    with pytest.raises(ValueError):
        M.read_back(M.container([hashlib.sha256(b"other").digest()], [zstandard.compress(b"a")]))


def targets(sizes):
    """Shares by weight, above twice the size reshared, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in full)
        level = (total - sum(2 * sizes[s] for s in full)) / free if free else 0
        more = {s for s in order if s not in full and weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def test_mix(docs_of, clash):
    rng = random.Random(4)
    rows = [(k, "w " * rng.choice([1, 5, 20, 40, 300]), "en", rng.choice(["a", "b", "b", "b", "b", "Z", "é", None, ""])) for k in range(900)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "b"), (1002, "w " * 20_000, "en", "b"), (1003, "", "en", "only empty")]
    docs = clash(docs_of(rows))
    got = mix(docs).collect()
    again = {r["doc_id"]: r["copies"] for r in mix(docs).collect()}
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    totals = {}
    for k, s in source.items():
        totals[s] = totals.get(s, 0) + size[k]
    want, taken = targets(totals), dict.fromkeys(totals, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and again[r["doc_id"]] == r["copies"]
        taken[s] += r["taken"]
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02, abs=2)
    assert len(got) == len(rows)


def test_mix_rates_solve_the_dual(docs_of):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randint(1, 60), "en", "a" if k % 4 else "b") for k in range(400)]
    by = {}
    for r in mix(docs_of(rows)).collect():
        by.setdefault(r["source_size"], []).append(r)
    for group in by.values():
        mean = np.mean([r["size"] for r in group])
        x, rate = np.array([r["size"] for r in group]) / mean, np.array([r["rate"] for r in group])
        assert (rate * np.array([r["size"] for r in group])).sum() == pytest.approx(group[0]["target"], rel=1e-5)
        free = rate < 2
        if free.any():  # log rates are one multiplier times size
            lam = np.log(rate[free]) / x[free]
            assert np.allclose(lam, lam[0], atol=1e-6)


def test_mix_edges(docs_of):
    assert mix(docs_of(["a"]).limit(0)).count() == 0
    assert [(r["size"], r["taken"]) for r in mix(docs_of([None, ""])).collect()] == [(0, 0)] * 2
    docs = docs_of([(1, "a b", "en", "s"), (1, "a b", "en", "s")])
    assert sorted(r["taken"] for r in mix(docs).collect()) == [2, 4]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_codec_equals_the_library(model):
    codec = Codec(model)
    rng = random.Random(6)
    pool = "abcdefgh   \n\t.,é漢字😀▁́ ABC0123"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["", " ", "  a  b ", "\n\n x\n", "x" * 500, "https://e.org/a?b=c&d=e#f" * 20, "\u0000\r\n ", " " * 99 + "z", "The quick brown fox.\nJumps over", "of the " * 30, "</s><s><unk>", "<0x41>"]
    ids, agree = codec.encode(texts)
    want = codec.library.encode(texts, add_bos=True, add_eos=True)
    assert [x.tolist() for x in ids] == want and agree


def test_codec_rows(docs_of, clash, model):
    texts = ["Hello world", None, "", "Hello world", "word " * 40_000]
    got = {r["doc_id"]: r for r in encode_decode(clash(docs_of(texts)), model, keep_ids=True).collect()}
    lib = Codec(model).library
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        r = got[k]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["agenda_ok"] and r["decoded"] == lib.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert encode_decode(docs_of(texts).limit(0), model).count() == 0
