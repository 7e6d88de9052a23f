"""Work that must stay spread over tasks, and steps that must run once."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from finledger.operators import ingest, ml, trends
from finledger.plans import catalog
from finledger.plans import ml_stream_queries as q
from finledger.sources.csv import read_export

LEDGER = "account_id long, month string, transaction_type string, is_saving int, amount decimal(18,2)"
ACCT = ("account_id",)


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def orders(spark, path, n):
    """``n`` orders of seven customers over three years."""
    k = F.col("id")
    spark.range(1, n + 1).select(
        k.alias("o_orderkey"), (k % 7).alias("o_custkey"), F.timestamp_seconds(852076800 + k * 7919 % 1095 * 86400).cast("timestamp_ntz").alias("o_orderdate"),
        (k * 37 % 10007 / 100.0 + 1).alias("o_totalprice")).write.parquet(str(path))


def filled_by_hand(rows):
    """{(account, month): expenses} with the missing calendar months of each account."""
    out = {}
    for account, month, _, _, amount in rows:
        out[account, month] = out.get((account, month), 0) + amount
    for account in {r[0] for r in rows}:
        real = sorted(int(m[:4]) * 12 + int(m[5:]) - 1 for a, m in out if a == account and m and len(m) == 7 and m[4] == "-")
        for no in range(real[0], real[-1] + 1) if real else ():
            out.setdefault((account, f"{no // 12:04d}-{no % 12 + 1:02d}"), Decimal(0))
    return out


def test_gaps_are_filled_behind_the_shuffle_by_key(spark):
    rnd = random.Random(3)
    months = [f"{y}-{m:02d}" for y in (1997, 1998, 2001) for m in (1, 2, 7, 12)] + ["1997/1/", "bad dat", "", None]
    rows = [(rnd.choice([None, 1, 2, 3, 4]), rnd.choice(months), "Debit", 0, Decimal(rnd.randint(1, 900))) for _ in range(60)]
    rows += [(9, "bad dat", "Debit", 0, Decimal(5)), (10, "2000-02", "Debit", 0, None), (10, "2000-04", "Debit", 0, Decimal(3))]
    out = trends.monthly_trends(spark.createDataFrame(rows, LEDGER), ACCT, fill_gaps=True)
    got = {(r.account_id, r.month): r.expenses for r in out.collect()}
    want = filled_by_hand([r for r in rows if r[4] is not None]) | {(10, "2000-02"): 0, (10, "2000-03"): 0}
    assert got == {k: float(v) for k, v in want.items()}
    assert out.count() == len(want)
    lines = plan(out)
    top = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert not [line for line in lines[:top] if "Exchange" in line]      # the added rows are never dealt again
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert any(f", {parts})" in line and "REPARTITION_BY_NUM" in line for line in lines[top:])     # and their tasks are not merged


def test_lines_of_an_export_are_numbered_without_one_task_for_all(spark, tmp_path):
    df = spark.range(0, 3000, numPartitions=3).selectExpr("id as n", "concat('t, ', id) as text")
    path = str(tmp_path / "csv")
    df.write.option("header", True).csv(path)
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")     # several splits a file, several tasks
        back = read_export(spark, path, "n long, text string")
        assert [(r.n, r.text, r.position) for r in back.orderBy("position").collect()] == [(n, f"t, {n}", n + 1) for n in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert back.columns == ["n", "text", "position"]
    orders(spark, tmp_path / "orders.parquet", 40)
    lines = plan(queries()["export_csv"](spark, str(tmp_path)))
    windows = [i for i, line in enumerate(lines) if "Window" in line]
    assert windows and all("_size" in lines[i] for i in windows)      # only the sizes of the splits meet in one task


def counting(spark, monkeypatch):
    """Statement lines whose narration is read by an ingest, and the derived lines."""
    seen = spark.sparkContext.accumulator(0)

    def same(text):
        seen.add(1)
        return text

    plain = catalog.statements
    counted = lambda s, d: plain(s, d).withColumn("narration", F.udf(same)("narration"))
    monkeypatch.setattr(catalog, "statements", counted)
    monkeypatch.setattr(q, "statements", counted)
    train = ml.train
    monkeypatch.setattr(ml, "train", lambda bag, *_: train(bag, 3))
    return seen, plain


@pytest.mark.parametrize("name", [
    "stream_daily_replayed", "ingest_compacted", "ingest_two_uploads", "ingest_upload_then_stream", "ml_expense", "ml_debit_type", "model_registry"])
def test_statement_lines_are_parsed_once(spark, tmp_path, monkeypatch, name):
    """However many uploads, bags and scores are made of them."""
    orders(spark, tmp_path / "orders.parquet", 120)
    seen, plain = counting(spark, monkeypatch)
    assert queries()[name](spark, str(tmp_path)).collect()
    assert seen.value == plain(spark, str(tmp_path)).count()


def test_registered_models_are_fitted_to_their_end(spark, tmp_path, monkeypatch):
    """The fits of the registry stop where the loss stops falling, not at a number of iterations."""
    orders(spark, tmp_path / "orders.parquet", 1040)
    ends, fit = [], ml.LogisticRegression.fit

    def counted(lr, data):
        m = fit(lr, data)
        ends.append((m.summary.totalIterations, lr.getMaxIter()))
        return m

    monkeypatch.setattr(ml.LogisticRegression, "fit", counted)
    rows = queries()["model_registry"](spark, str(tmp_path)).collect()
    assert [(r.step, r.reused) for r in rows] == [("corrected", False), ("as ingested", False), ("corrected again", True)]
    assert len(ends) == 2 * len(ml.MODEL_NAMES)
    assert all(steps < most == ml.MAX_ITER for steps, most in ends)


def test_stored_keys_meet_new_rows_in_one_shuffle(spark):
    fields = "account_id long, hash string, source_file string, row_seq long, amount decimal(18,2), note string"
    tx = spark.createDataFrame([(1, "a", None, 2, Decimal(1), "second"), (1, "a", None, 1, Decimal(1), "first"), (None, "a", None, 3, Decimal(1), "x"),
                                (None, "b", None, 4, Decimal(1), None), (2, "c", None, 5, None, "dropped"), (1, "d", None, 6, Decimal(2), "y")], fields)
    stored = spark.createDataFrame([(None, "a"), (None, "a"), (2, "a"), (1, "d"), (7, "z")], "account_id long, hash string")
    out = ingest.new_rows(tx, stored)
    assert out.columns == tx.columns
    assert sorted((r.hash, r.account_id, r.row_seq, r.note) for r in out.collect()) == [("a", 1, 1, "first"), ("b", None, 4, None)]
    assert [r.hash for r in ingest.new_rows(tx, stored, ()).collect()] == ["b"]
    lines = plan(ingest.new_rows(tx, stored))
    assert not [line for line in lines if "Join" in line]
    assert sum("Exchange" in line for line in lines) == 1
