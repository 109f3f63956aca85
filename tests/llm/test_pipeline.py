"""The pipeline's stages against what each says of itself, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arcwright.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_the_columns_and_act(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= set(seen), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    decoded = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("d")).distinct()
    assert last.select("doc_id", F.col("decoded_sha256").alias("d")).distinct().exceptAll(decoded).count() == 0


def test_one_of_each_keeps_a_repeated_row_once(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other"), (None, "x"), (None, "x"), (4, None), (4, None)]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "a b c d e f"), (3, "other"), (None, "x"), (None, "x"), (4, None)]))


def test_one_of_each_tells_rows_by_their_text(spark):
    rows = [(1, "a b c d e f", 0), (5, "a b c d e f", 1), (5, "another text here", 2), (5, "", 3), (5, None, 4), (7, "a b c d e f", 5), (7, "u v w x y z a b c d", 6), (7, "u v w x y z a b c d  ", 7), (8, "u v w x y z a b c d", 8), (None, "a b c d e f", 9)]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, _turn int"), SF)
    assert got.columns == ["doc_id", "text", "_turn"] and sorted(r["_turn"] for r in got.collect() if r["_turn"] not in (6, 7)) == [0, 2, 3, 4, 9]
    assert sum(r["_turn"] in (6, 7) for r in got.collect()) == 1


def test_stages_on_odd_tables(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (None, words, None, None, 2), (None, None, None, None, 3), (2, "", "en", "b", 4), (3, words + " more", "en", "b", 5), (3, "quite other words stand in this one", "en", "b", 6)]
    kept = "doc_id long, text string, lang string, source string, n_chars long"
    for some in (rows, []):
        docs = spark.createDataFrame([(*r, "x", r[4]) for r in some], kept + ", _gone string, copies long")
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            docs = corpus_pipeline.settle(stage(spark, docs, SF), "test")
            assert docs.columns[-2:] == ["_gone", "copies"], name
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= {r[0] for r in some} and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("name", ["op1_lattice", "op2_warc", "op3_lines", "op5_jaccard", "op6_exact_topk"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
