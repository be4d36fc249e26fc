"""The queries and the pipeline as the driver runs them."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidepool.llm import entry, neardup, phrases
from tidepool.llm import pipeline as stages
from tidepool.llm.common import table

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.QUERIES[name](spark, DIR)
    result = con.execute(entry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want


def test_all_queries_have_a_row_for_each_document(spark):
    n = table(spark, DIR, "documents").count()
    assert set(entry.QUERIES) >= {"op1_bpe", "op2_idstore", "op9_ctw"}
    for name, query in entry.QUERIES.items():
        if name not in ("op7_chat",):
            assert query(spark, DIR).count() == n, name


def test_stages_against_brute_force(spark):
    docs, before = table(spark, DIR, "documents"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stages.stored(stage(spark, docs, DIR), name)
        rows = before.select("doc_id", "text").collect()
        if name != "encoded":
            assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.collect()}
        if name == "near_copies":
            assert kept == {k for k, _, _, keep in neardup.brute_force([tuple(r) for r in rows], 5) if keep}
        if name == "decontaminated":
            items = [tuple(r) for r in table(spark, DIR, "benchmark").collect()]
            assert kept == {r[0] for r in phrases.brute_force([tuple(r) for r in rows], items) if not r[-1]}
    assert docs.count() == before.count() and np.all([r["n_tokens"] > 0 for r in docs.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DIR).select("doc_id").collect()) == sorted(kept)


def test_stages_on_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "en", "x"), (2, "", None, "x"), (None, "word " * 60, "en", "x"), (3, "word " * 60, "en", "x")], "doc_id long, text string, lang string, `a.b` string")
    for df in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, df, DIR)
            got.collect()
            assert name == "encoded" or got.columns == df.columns


def test_language_ties_are_rejected(spark):
    rows = [(i, "the cat sat on the mat and the dog ran", "en") for i in range(5)] + [(i + 5, "le chat est sur la table et le chien court", "fr") for i in range(5)]
    docs = spark.createDataFrame([*rows, (20, "\u4f60\u597d \u4e16\u754c", None), (21, "12 34", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in stages.language(spark, docs, DIR).collect()} == set(range(10))


def test_contaminated_rows_go_whatever_their_id(spark):
    item = table(spark, DIR, "benchmark").where("size(split(text, ' ')) > 20").first()["text"]
    rows = [(None, item), (None, "clean words"), (7, item), (7, "other clean words"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in stages.decontaminated(spark, docs, DIR).collect()}
    assert got == {(None, "clean words"), (7, "other clean words"), (8, None)}
