"""Registered queries against their DuckDB oracle on the smallest scale factor.

The full set runs with ``scripts/check_oracle.py`` (sf0.01); here a
representative subset keeps the suite fast.
"""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF_SMALL
from scripts.check_oracle import TABLES, _rows

SUBSET = [
    "parse_dates", "keyword_labels", "ingest_dedup", "ingest_report", "summary_by_account",
    "monthly_trends", "anomalies", "growth_rates", "forecast_by_account", "seasonal",
    "budget_vs_actual", "suggestions", "festival_history", "upcoming_festivals_reference_mode",
    "festive_vs_normal", "subscription_audit_by_account", "what_if", "training_bag",
    "ingest_two_uploads", "ingest_upload_then_stream", "ingest_no_account", "stream_daily", "ingest_incremental_report",
    "festival_history_by_account", "export_csv",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle_or_is_iterative():
    missing = set(queries()) - set(oracle_sql())
    plain = {n for n in missing if not n.startswith("op") and n != "pipeline"}  # training-data queries have their own tests
    assert plain <= {"ml_debit_type", "ml_expense", "ml_savings", "ml_classified_ingest"}


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["month", "income", "expenses", "savings", "expense_ma3", "expense_ma6", "savings_rate"]


@pytest.mark.parametrize("name", SUBSET)
def test_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = _rows(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want
