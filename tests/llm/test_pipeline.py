"""The corpus pipeline, stage by stage, and the registered queries on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from finledger.llm import queries
from finledger.llm._common import table, written
from test_operators import COLUMNS, ROWS, brute_components, brute_fp, brute_kept, brute_windows

from collections import Counter

NAMES = ["op1_quality_classifier", "op2_packing", "op3_url_filters", "op4_substring_dedup", "op5_mixing", "op6_license_scans",
         "op7_quality_rules", "op8_simhash_dedup", "op9_document_fingerprints", "op10_sharding"]


def test_every_operator_is_registered():
    import __spark_entry__

    every = {*NAMES, "op11_conversation_trie", "op12_embedding_whitening", "op13_piece_encoding"}
    assert every == set(queries.QUERIES) and every | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", NAMES)
def test_queries_return_every_row(spark, name):
    out = queries.QUERIES[name](spark, SF_SMALL)
    key = "page_id" if name.startswith("op3") else "doc_id"
    n = table(spark, SF_SMALL, "pages" if key == "page_id" else "documents").count()
    assert out.select(key).distinct().count() == n
    assert name == "op2_packing" or out.count() == n


def test_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["quality rules", "simhash near-dedup", "substring dedup", "mixing", "packing"]
    rules = written(stages[0][1](spark, docs, SF_SMALL), "t")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert Counter(r["doc_id"] for r in rules.collect()) == Counter(d for (d, k), n in brute_kept(rows, 20, 0.3).items() if k)
    near = written(stages[1][1](spark, rules, SF_SMALL), "t")
    fps = {r["doc_id"]: brute_fp(r["text"]) for r in rules.collect()}
    assert {r["doc_id"] for r in near.collect()} == {min(c) for c in brute_components(fps).values()}
    less = written(stages[2][1](spark, near, SF_SMALL), "t")
    want = {d: kept for d, _, _, kept in brute_windows([(r["doc_id"], r["text"]) for r in near.collect()])}
    assert {r["doc_id"]: r["text"] for r in less.collect()} == want
    mixed = written(stages[3][1](spark, less, SF_SMALL), "t")
    for d in (rules, near, less, mixed):
        assert d.columns == docs.columns
        assert d.where(F.length("text") != F.col("n_chars")).count() == 0 or d is near
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= {r["doc_id"] for r in less.collect()} and max(copies.values()) <= 2
    packed = stages[4][1](spark, mixed, SF_SMALL)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] for r in tokens} == {r["doc_id"]: r["t"] * copies[r["doc_id"]] for r in tokens}


def test_stages_on_edge_rows(spark):
    docs = spark.createDataFrame(ROWS, COLUMNS).withColumns({c: F.lit(c) for c in ("_id", "n_words", "copies", "_row")})
    for rows in (docs, docs.where("false")):
        d = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = written(stage(spark, d, SF_SMALL), "t")
            assert d.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, d, SF_SMALL).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = con.execute(queries.SQL[name])
    cols = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(want.fetchall())
