"""Queries of the subpackage against their SQL, and the pipeline against its rules."""

import duckdb
import pytest

from tests.test_oracle import KINDS, rows_of
from zonestat.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert {c: KINDS.get(kind, kind) for c, kind in df.dtypes} == {d[0]: str(d[1]) for d in cursor.description}
    assert rows_of(df.collect(), df.columns) == rows_of(cursor.fetchall(), names)


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    n = [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n.append(docs.count())
        if k + 1 < len(P.STAGES):
            assert docs.columns == columns
        if name in ("exact", "near"):
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert [name for name, _ in P.STAGES] == ["language", "exact", "near", "mixture", "tokens"]
    assert n[0] >= n[1] >= n[2] >= n[3] and n[1] > 0.9 * n[0] and n[5] == n[4]
    assert P.run(spark, sf).count() == n[5]


def test_pipeline_stages_on_odd_rows(spark, docs_of, clash, sf):
    import corpus_pipeline as P

    rows = [(k, f"the small house number {k} stands by the old river and waits {k * 7}", "en", "s") for k in range(30)]
    rows += [(40, None, "en", None), (41, "", "en", "s"), (42, "das Haus " * 30_000, None, None), (None, "a house without a number", "en", "s"), (44, "THE small house", "en", "t"), (45, "the SMALL house", "en", "t"), (45, "the SMALL house", "en", "t")]
    docs = clash(docs_of(rows)).selectExpr("*", "1 AS taken_id", "2 AS taken_copies", "3 AS lettered", "4 AS keep_id")
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0 and empty.columns == out.columns
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "language":
            assert 40 not in ids and 41 not in ids and None in ids and 0 in ids
        if name == "exact":
            assert ids.count(45) == 1 and 44 not in ids and ids.count(None) == 1
        if name == "near":
            assert 44 not in ids or 45 not in ids
