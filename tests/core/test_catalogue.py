"""Every query of the catalogue against its SQL in DuckDB, over the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def names():
    from tracewright.plans.oracles import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from tracewright.plans.catalogue import QUERIES
    from tracewright.plans.oracles import ORACLES

    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(str(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_batch_with_odd_ids(spark, tmp_path, monkeypatch):
    """Repeated and null ids, empty and null texts and ties; texts and questions in blocks of two; no pairs are shuffled."""
    import duckdb

    from tracewright.operators import ranking
    from tracewright.plans.catalogue import QUERIES
    from tracewright.plans.oracles import ORACLES

    monkeypatch.setattr(ranking, "SCORED_ROWS", 2)
    monkeypatch.setattr(ranking, "SCORED_QUESTIONS", 2)
    words = "apple pear plum fig quince".split()
    docs = [(i, " ".join(words[j % 5] for j in range(i % 4, i % 4 + 1 + i % 3)) + " filler") for i in range(40)]
    docs += [(3, "apple fig"), (3, None), (7, "plum"), (None, "apple quince"), (None, "fig"), (99, ""), (98, None), (97, "quince quince pear")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(i, f"{a} {b} the") for i, (a, b) in enumerate((a, b) for a in words for b in words)] + [(50, "absent"), (51, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["bm25_batch"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("item_id", "doc_id", "score", "place").collect())) == sorted(con.sql(ORACLES["bm25_batch"]).fetchall())
