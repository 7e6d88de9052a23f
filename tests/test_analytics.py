"""Trends, anomalies, growth, seasonality, forecast.

Golden values: the statements of conftest.py, computed
independently (see FIXTURES.md section 2).
"""

from pyspark.sql import functions as F

from conftest import AUTUMN, FESTIVE_YEAR, QUARTER
from finledger.operators import summary, trends


def test_monthly_trends_three_months(spark, csv_ledger):
    led = csv_ledger(QUARTER)
    got = [(r.month, r.income, r.expenses, r.savings, r.expense_ma3, r.expense_ma6, r.savings_rate)
           for r in trends.monthly_trends(led).collect()]
    assert got == [
        ("2023-04", 42000.0, 3120.0, 3500.0, 3120.0, 3120.0, 8.3),
        ("2023-05", 43500.0, 4180.0, 3500.0, 3650.0, 3650.0, 8.0),
        ("2023-06", 45600.0, 2480.0, 3500.0, 3260.0, 3260.0, 7.7),
    ]
    s = summary.summary(led).first()
    assert (s.total_income, s.total_expenses, s.total_savings, s.total_count) == (131100.0, 20280.0, 10500.0, 12)


def test_monthly_trends_empty(spark, csv_ledger):
    led = csv_ledger("Date,Narration,Debit Amount,Credit Amount\n2023-07-15,X,0,0\n")
    assert trends.monthly_trends(led).count() == 0


def test_anomalies(spark, csv_ledger):
    led = csv_ledger(QUARTER)
    got = [(r.month, r.category, r.amount, r.average, r.spike_pct) for r in trends.anomalies(led, 1.0).collect()]
    assert got == [("2023-05", "Shopping", 3600.0, 2500.0, 44.0), ("2023-06", "Food & Dining", 980.0, 760.0, 28.9)]
    assert trends.anomalies(led, 1.5).count() == 0


def test_anomalies_uncategorized(spark, csv_ledger):
    led = csv_ledger(FESTIVE_YEAR)
    got = [(r.month, r.category, r.amount, r.average, r.spike_pct) for r in trends.anomalies(led, 1.5).collect()]
    assert got == [("2022-10", "Uncategorized", 11400.0, 5050.0, 125.7)]
    last = trends.monthly_trends(led).collect()[-1]
    assert (last.month, last.expense_ma3, last.expense_ma6) == ("2022-12", 6233.33, 5050.0)


def test_forecast(spark, csv_ledger):
    f = trends.forecast(csv_ledger(QUARTER)).first()
    assert (f.forecast_expenses, f.expense_change_per_month, f.expense_trend) == (6120.0, -320.0, "decreasing")
    assert (f.forecast_income, f.income_change_per_month, f.income_trend) == (47300.0, 1800.0, "increasing")
    assert f.months_analyzed == 3


def test_forecast_needs_two_months(spark, csv_ledger):
    led = csv_ledger("Date,Narration,Debit Amount,Credit Amount\n2023-07-15,KFC BUCKET,640,0\n")
    assert trends.forecast(led).count() == 0


def test_growth_rates(spark, csv_ledger):
    got = {r.category: (r.growth_pct, r.recent_avg) for r in trends.growth_rates(csv_ledger(QUARTER)).collect()}
    assert got == {"Food & Dining": (116.7, 780.0), "Retirement": (100.0, 3500.0), "Shopping": (112.5, 2550.0)}
    got2 = {r.category: r.growth_pct for r in trends.growth_rates(csv_ledger(AUTUMN)).collect()}
    assert got2 == {"Stocks": 0.0, "Food & Dining": -12.9, "Shopping": -38.1}


def test_seasonal(spark, csv_ledger):
    got = [(r.cal_month, r.month_name, r.avg_daily_spend, r.total_spend, r.txn_count, r.vs_average_pct)
           for r in trends.seasonal_patterns(csv_ledger(QUARTER)).collect()]
    assert got == [
        (4, "April", 2206.67, 6620.0, 3, -2.1),
        (5, "May", 2560.0, 7680.0, 3, 13.6),
        (6, "June", 1993.33, 5980.0, 3, -11.5),
    ]


def test_daily_spending_and_heatmap(spark, csv_ledger):
    led = csv_ledger(QUARTER)
    days = summary.daily_spending(led, months_back=3).collect()
    assert days[0].date == "2023-06-28" and len(days) == 9
    assert summary.daily_spending(led, months_back=0).count() == 0
    hm = summary.spending_heatmap(led, 6).collect()
    assert sum(r.total for r in hm) == 20280.0
    first = hm[0]
    assert first.weekday_no == min(r.weekday_no for r in hm)
    wide = summary.heatmap_matrix(summary.spending_heatmap(led, 6))
    assert wide.count() == len({r.weekday for r in hm})


def test_per_account_equals_global_when_one_account(spark, csv_ledger):
    led = csv_ledger(QUARTER)
    g = trends.monthly_trends(led).drop("account_id").collect()
    a = trends.monthly_trends(led, ("account_id",)).orderBy("month").drop("account_id").collect()
    assert g == a


def test_additive_ops_sum_over_accounts(spark):
    from finledger.plans.catalog import ledger_of
    led = ledger_of(spark, "/root/testdata/sf0.001")
    g = summary.summary(led).first()
    per = summary.summary(led, ("account_id",)).agg(
        F.sum("total_income").alias("i"), F.sum("total_expenses").alias("e"), F.sum("total_count").alias("n")).first()
    assert round(per.i, 2) == round(g.total_income, 2)
    assert round(per.e, 2) == round(g.total_expenses, 2)
    assert per.n == g.total_count


def test_moving_average_of_constant(spark, csv_ledger):
    text = "Date,Narration,Debit Amount,Credit Amount\n" + "".join(
        f"2023-{m:02d}-10,KFC BUCKET,700,0\n" for m in range(1, 10))
    for r in trends.monthly_trends(csv_ledger(text)).collect():
        assert r.expense_ma3 == 700.0 and r.expense_ma6 == 700.0
