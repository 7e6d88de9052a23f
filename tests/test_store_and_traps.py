"""Uploads, streams and keys that once lost or repeated rows."""

import pytest
from pyspark.sql import functions as F

from conftest import statement, write_csv
from finledger.functions.text import cal_month_of
from finledger.operators import corrections, festivals, habits, ingest, ledger as rows, trends
from finledger.sources.csv import read_statement_csv
from finledger.sources.store import append_new, append_training, read_ledger, stream_writer
from finledger.streaming import ingest_stream as st


def _upload(spark, tmp_path, path, name, *lines, account_id=None):
    src = write_csv(tmp_path, name, statement(*lines))
    return append_new(spark, ingest.prepare_transactions(read_statement_csv(spark, src, account_id=account_id)), path)


def test_a_line_without_account_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert _upload(spark, tmp_path, path, "a", "2023-07-04,KFC BUCKET,640,0").count() == 1
    assert _upload(spark, tmp_path, path, "b", "2023-07-04,KFC BUCKET,640,0").count() == 0
    assert read_ledger(spark, path).count() == 1


def test_a_stream_keeps_what_uploads_stored(spark, tmp_path):
    path, incoming = str(tmp_path / "ledger"), tmp_path / "incoming"
    _upload(spark, tmp_path, path, "a", "2023-07-04,KFC BUCKET,640,0", "2023-07-05,PIZZA NIGHT,300,0", account_id=1)
    incoming.mkdir()
    (incoming / "x.csv").write_text(statement("2023-07-04,KFC BUCKET,640,0", "2023-07-06,NYKAA BOX,90,0"))
    for ck in ("c1", "c2"):  # a second checkpoint starts at batch 0 again
        st.start_ingest(st.statement_csv_stream(spark, str(incoming), account_id=1), path, str(tmp_path / ck)).awaitTermination()
    assert sorted(r.processed for r in read_ledger(spark, path).collect()) == ["KFC BUCKET", "NYKAA BOX", "PIZZA NIGHT"]
    assert stream_writer(spark, str(tmp_path / "c1")) == stream_writer(spark, str(tmp_path / "c1")) != stream_writer(spark, str(tmp_path / "c2"))


def test_a_replayed_batch_rewrites_its_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    src = write_csv(tmp_path, "a", statement("2023-07-04,KFC BUCKET,640,0", "odd,PIZZA NIGHT,1,0"))
    tx = ingest.prepare_transactions(read_statement_csv(spark, src, account_id=1))
    for _ in range(2):
        append_new(spark, tx, path, 3, writer="w")
        append_training(read_ledger(spark, path), str(tmp_path / "bag"), 3, "w")
    assert read_ledger(spark, path).count() == 2
    assert spark.read.parquet(str(tmp_path / "bag")).count() == 2
    r = read_ledger(spark, path).select("writer", "batch", F.col("uploaded_at").isNotNull().alias("t")).distinct().collect()
    assert [tuple(x) for x in r] == [("w", 3, True)]


@pytest.mark.parametrize("date", [" ", "\t", "", "someday"])
def test_an_odd_date_is_stored_once(spark, tmp_path, date):
    path = str(tmp_path / "ledger")
    for name in "ab":
        _upload(spark, tmp_path, path, name, f"{date},KFC BUCKET,640,0", "2023-07-04,PIZZA NIGHT,1,0", account_id=1)
    got = sorted((r.date, r.month) for r in read_ledger(spark, path).collect())
    assert got == sorted([(date.strip(), date.strip()[:7]), ("2023-07-04", "2023-07")])


def test_a_dropped_line_never_hides_a_kept_one(spark, csv_ledger):
    # hash text of the dropped line: date|X|500.0|Debit without an amount
    led = csv_ledger(statement("2023-07-04,X|500.0,abc,0", "2023-07-04,X,500,0"))
    assert [r.processed for r in led.collect()] == ["X"]


def test_the_report_is_one_consistent_count(spark, tmp_path):
    path = str(tmp_path / "ledger")
    _upload(spark, tmp_path, path, "a", "2023-07-04,KFC BUCKET,640,0")
    lines = read_statement_csv(spark, write_csv(tmp_path, "b", statement(
        "2023-07-04,KFC BUCKET,640,0", "2023-07-04,KFC BUCKET,640,0", "2023-07-05,ODD THING,5,0", "2023-07-05,ODD THING,x,0", ",,0,0")))
    r = ingest.ingest_report(lines, read_ledger(spark, path)).first()
    assert (r.total_rows, r.inserted, r.skipped, r.dropped, r.uncategorized) == (5, 1, 2, 2, 1)


def test_late_statements_count_in_daily_totals(spark, tmp_path):
    path, days = str(tmp_path / "ledger"), str(tmp_path / "days")
    for name, line in (("a", "2023-06-05,KFC BUCKET,640,0"), ("b", "2023-01-02,PIZZA NIGHT,300,0"), ("c", "2023-06-05,NYKAA BOX,60,0")):
        _upload(spark, tmp_path, path, name, line, account_id=1)
        st.start_daily_totals(spark, path, days, str(tmp_path / "ck")).awaitTermination()
    got = {str(r.day): float(r.total) for r in st.daily_totals(spark, days).collect()}
    assert got == {"2023-06-05": 700.0, "2023-01-02": 300.0}


@pytest.mark.parametrize("text,month", [("2024/3/5 10:00", 3), ("2023-11-27", 11), ("2023-1x", 1), ("bad date", 0), ("", 0), ("xxxx -5", -5), ("abcde+7", 7)])
def test_calendar_month(spark, text, month):
    assert spark.createDataFrame([(text,)], "d string").select(cal_month_of("d")).first()[0] == month


def test_corrections_without_account(spark, csv_ledger):
    led = csv_ledger(statement("2023-07-05,ODD THING,5,0")).withColumn("account_id", F.lit(None).cast("long"))
    h = led.first().hash
    corr = spark.createDataFrame([(None, h, "Shopping", 0, None)], corrections.CORRECTION_SCHEMA)
    assert corrections.apply_corrections(led, corr).first().category == "Shopping"
    assert corrections.correction_training_rows(led, corr).count() == 1


def test_accounts_without_debits_have_festivals(spark, csv_ledger):
    led = csv_ledger(statement("2023-07-05,PAYROLL JULY,0,100"))
    table = festivals.festivals_table(spark)
    assert festivals.festival_history(led, table).count() == festivals.festival_history(led, table, ("account_id",)).count() == table.count()
    assert {r.avg_spend for r in festivals.festival_history(led, table, ("account_id",)).collect()} == {0.0}


def test_dimensions_of_any_size(spark, csv_ledger):
    led = csv_ledger(statement("2023-07-05,KFC BUCKET,100,0", "2023-10-05,KFC BUCKET,300,0"))
    many = festivals.festivals_table(spark, [(i, f"F{i}", i % 12 + 1, 1, 1, 1) for i in range(10_500)])
    for by in ((), ("account_id",)):
        assert festivals.festival_history(led, many, by).count() == 10_500
        sc = spark.range(100_500).select(F.lit("Food & Dining").alias("category"), (F.col("id") % 100).cast("double").alias("reduction_pct"))
        assert habits.what_if(led, sc, by).count() == 100_500
    assert festivals.festive_vs_normal(led, many).first().normal_months_count == 0


def test_pages_have_a_total_order(spark, tmp_path):
    a = write_csv(tmp_path, "a", statement("2023-07-05,KFC BUCKET,1,0"))
    b = write_csv(tmp_path, "b", statement("2023-07-05,PIZZA NIGHT,1,0"))
    led = ingest.build_ledger(read_statement_csv(spark, a, account_id=1).unionByName(read_statement_csv(spark, b, account_id=1)))
    pages = [rows.ledger_page(led, 1, i).first().hash for i in range(2)]
    assert len(set(pages)) == 2


def test_a_cluster_without_a_shared_folder_is_an_error():
    from finledger.session import shared_dir

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_forecast_of_one_account_equals_global(spark, csv_ledger):
    led = csv_ledger(statement("2023-07-05,KFC BUCKET,100,0", "2023-08-05,KFC BUCKET,300,0"))
    assert trends.forecast(led).first().forecast_expenses == trends.forecast(led, ("account_id",)).first().forecast_expenses


def test_nested_folders_and_three_header_layouts(spark, tmp_path):
    d = tmp_path / "in"
    (d / "deep" / "er").mkdir(parents=True)
    (d / "a.csv").write_text(statement("2023-07-04,KFC BUCKET,640,0", '2023-07-05,"A, ""B""\nC",1,0'))
    (d / "deep" / "b.csv").write_text("﻿Credit Amount, Narration ,Extra,Date,Debit Amount,Account\n0,PIZZA NIGHT,x,2023-07-06,\"1,250.50\",7\n")
    (d / "deep" / "er" / "c.csv").write_text("Account,Date,Narration,Debit Amount,Credit Amount\n8,2023-07-07,NYKAA BOX,5,0\n")
    lines = read_statement_csv(spark, str(d), account_id=1, account_column="Account", strip_thousands=True)
    got = sorted((r.account_id, r.date_text, r.narration, r.debit_text) for r in lines.collect())
    assert got == [(1, "2023-07-04", "KFC BUCKET", "640"), (1, "2023-07-05", 'A, "B"\nC', "1"),
                   (7, "2023-07-06", "PIZZA NIGHT", "1250.50"), (8, "2023-07-07", "NYKAA BOX", "5")]
    split = read_statement_csv(spark, str(d / "deep"), account_id=1, multi_line=False)
    assert sorted(r.debit_text for r in split.collect()) == ["1,250.50", "5"]


def test_options(spark, csv_ledger):
    led = csv_ledger(statement("2023-01-05,KFC BUCKET,100,0", "2023-04-05,KFC BUCKET,200,0", "2023-04-06,NYKAA BOX,50,0"))
    assert [(r.month, r.expenses, r.expense_ma3) for r in trends.monthly_trends(led, fill_gaps=True).collect()] == [
        ("2023-01", 100.0, 100.0), ("2023-02", 0.0, 50.0), ("2023-03", 0.0, 33.33), ("2023-04", 250.0, 83.33)]
    assert {r.category: r.total for r in habits.discretionary(led, months=1).collect()} == {"Food & Dining": 200.0, "Shopping": 50.0}
    t = spark.createDataFrame([("budget_overrun",)], "type string").select(habits.type_label()).first()[0]
    assert t == "Budget Overrun"
