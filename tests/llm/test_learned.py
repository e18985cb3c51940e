"""Language and toxicity: held-out accuracy on the given tables, and odd rows."""

import numpy as np
import pytest

from zonestat.llm import language_id as L
from zonestat.llm.toxicity import apart, calibrate, fit, grams, runs, toxicity, windows

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_language_held_out(documents):
    got = L.language_id(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()


def test_folded_tables_are_the_network():
    net = L.ByteConvNet(["a", "b", "c"])
    x = np.random.default_rng(0).integers(0, 256, (50, L.WINDOW)).astype(np.uint8)
    assert np.allclose(net.log_probabilities(x), net.folded().log_probabilities(x), atol=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.choice(list(b"abc "), (80, L.WINDOW)), rng.choice(list(b"xyz "), (80, L.WINDOW))]).astype(np.uint8)
    y = np.repeat([0, 1], 80)
    net = L.ByteConvNet(["a", "x"])
    net.fit(x, y, steps=60)
    assert (net.log_probabilities(x).argmax(1) == y).all()


def test_windows_cover_whole_texts():
    data, starts, ends = L.text_bytes(__import__("pyarrow").array(["a" * 700, "", "é"]))
    start, length, owner = L.as_windows(data, starts, ends)
    assert np.bincount(owner, weights=length).tolist() == [700, 0, 2] and length.max() <= L.WINDOW


def test_language_of_odd_rows(docs_of, clash):
    rows = [(k, t, lang, None) for k, (t, lang) in enumerate([("the house is old " * 9, "en"), ("das Haus ist alt " * 9, "de")] * 30)]
    odd = [(100, None, "en", "s"), (101, "", "de", "s"), (102, "12 34 !?", None, "s"), (None, "the house", "en", "s"), (104, "das Haus " * 20000, None, "s"), (104, "das Haus " * 20000, None, "s")]
    docs = clash(docs_of(rows + odd))
    got = {r["doc_id"]: r for r in L.language_id(docs).collect()}
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[104]["lang_pred"] == "de" and got[None]["held_out"] is False
    kept = L.language_id(docs, keep=True)
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() == docs.count()
    assert L.language_id(docs.limit(0)).count() == 0
    unlabelled = docs_of([(1, "text", None, None)])
    assert [(r["lang_pred"], r["score"]) for r in L.language_id(unlabelled).collect()] == [("und", 0.0)]


def test_toxicity_held_out(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got["toxic"] == 1], got[got["toxic"] == 0]
    assert (toxic["predicted"] == 1).mean() >= 0.6  # some labelled texts hold no toxic word
    assert (clean["predicted"] == 1).mean() <= 0.03
    assert (got["predicted"] == (got["score"] >= 0.7)).all()


def test_toxicity_of_odd_rows(spark, docs_of, clash):
    bad = [(k, f"quiet words {k} horriblebadword follow {k * 7}", "en", "s") for k in range(40)]
    good = [(100 + k, f"quiet words {k} of peace follow {k * 11}", "en", "s") for k in range(40)]
    odd = [(300, None, "en", "s"), (301, "", "en", "s"), (302, "x" * 300_000, None, None), (None, "horriblebadword", "en", "s")]
    docs = clash(docs_of(bad + good + odd))
    labels = spark.createDataFrame([(k, 0, 1) for k in range(40)] + [(100 + k, 1, 0) for k in range(40)] + [(5, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    assert len(got) == 84 and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[k]["score"] for k in range(40)]) > np.mean([got[100 + k]["score"] for k in range(40)])
    assert got[300]["score"] == got[301]["score"]
    assert {r["score"] for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_parts():
    assert b"".join(w[:48] for w in windows(b"a" * 64)) == b"a" * 48 and len(windows(b"")) == 1
    assert len(windows(b"x" * 1000)[-1]) <= 64 and sum(48 for _ in windows(b"x" * 1000)) + 16 >= 1000
    wanted = np.zeros(1 << 24, bool)
    wanted[grams(b"badword")] = True
    assert runs(b"a badword here", wanted) == [b"badword"]
    w, _, _ = calibrate(np.array([[0.0], [1.0], [0.0], [1.0]]), np.array([0.0, 1, 0, 1]))
    assert w[1] > 0
    assert fit([b"good text here"] * 3, [b"bad text there"] * 3).score(np.zeros((1, 6))).shape == (1,)


def test_a_common_header_makes_no_copies():
    rng = np.random.default_rng(3)
    fill = lambda n: b" ".join(b"w%d" % k for k in rng.integers(0, 10**6, n))
    header = b"this notice of seventy bytes stands before each of the texts of a source. " * 2
    bad = [header + fill(20) + b" horriblebadword " + fill(20) for _ in range(40)]
    good = [header + fill(40) for _ in range(40)]
    model = fit(good, bad)
    score = lambda t: model.score(model.features(t)[None])[0]
    assert b"horriblebadword" in model.toxic
    assert score(header + fill(20) + b" horriblebadword " + fill(20)) > 0.7 > score(header + fill(40))
    assert len(apart(bad)) == 40 and len(apart([t + b" end" for t in bad] + bad + bad)) == 40


def test_the_sample_is_full_and_holds_every_language(spark, docs_of, monkeypatch):
    common = [(k, f"the house number {k} is old", "en" if k % 60 == 0 else None, "s") for k in range(12000)]
    rare = [(20000 + k, f"das Haus Nummer {k} ist alt", "de", "s") for k in range(3)]
    seen = {}
    fit = L.ByteConvNet.fit
    monkeypatch.setattr(L.ByteConvNet, "fit", lambda net, x, y, **more: (seen.update(n=np.bincount(y).tolist(), classes=net.classes), fit(net, x, y, **more)))
    docs = docs_of(common + rare)
    L.train(docs, "doc_id", "text", "lang", sample=60)
    assert seen["classes"] == ["de", "en"] and seen["n"][0] >= 1 and 59 <= sum(seen["n"]) <= 60
    assert L.quotas({"a": 10**9, "b": 5}, 4000)["b"] == 5 and L.quotas({"a": 3, "b": 5}, 4000) == {"a": 3, "b": 5}
