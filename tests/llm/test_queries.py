"""The registered queries over the smallest tables against brute force and SQL, and the pipeline stage by stage."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def run(spark, name):
    from tracewright.llm.registry import QUERIES

    return QUERIES[next(n for n in QUERIES if n.startswith(f"{name}_"))](spark, SF).collect()


def test_words(spark, rows):
    from test_substring import brute

    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op1")) == brute(rows, 35)


def test_bytes(spark, rows):
    from test_suffixes import brute

    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op8")) == brute(rows, 50)


def test_similar(spark, rows):
    from test_jaccard import brute

    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.copies, r.n_grams) for r in run(spark, "op7")) == brute(rows, 5, 0.8)


@pytest.mark.parametrize("name", ["op5", "op6"])
def test_sql(spark, name):
    import duckdb

    from tracewright.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    full = next(n for n in QUERIES if n.startswith(f"{name}_"))
    df, sql = QUERIES[full](spark, SF), con.sql(ORACLES[full])
    columns = sorted(df.columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as C
    from test_exact import brute as exact_brute
    from test_jaccard import brute as similar_brute

    from tracewright.llm import decontaminate, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in C.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()] if name != "packing" else None
        after = stage(spark, docs, SF)
        ids = sorted({r.doc_id for r in after.select("doc_id").collect()})
        if name == "toxicity":
            scored = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert ids == sorted(r.doc_id for r in scored if not r.predicted)
        elif name == "exact_dedup":
            assert ids == sorted(int(d) for d, _, _, k, _ in exact_brute(before) if k)
        elif name == "ngram_jaccard":
            assert ids == sorted(int(d) for d, c, _, _, n in similar_brute(before, 5, 0.8) if d == c or not n)
        elif name == "decontamination":
            items = [decontaminate.canonical(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            exact_leaks = {d for d, t in before if any(i in decontaminate.canonical(t) for i in items)}
            assert not exact_leaks & set(ids) and len(ids) + len(exact_leaks) <= len(before)
        else:
            assert ids == kept["decontamination"]
            break
        assert after.columns == columns
        kept[name] = ids
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert C.run(spark, SF).select("doc_id").distinct().count() == len(kept["decontamination"])
