"""Budgets, 50/30/20, discretionary, subscriptions, what-if, suggestions."""

import datetime as dt

from conftest import AUTUMN, QUARTER
from finledger.operators import budget, habits


def _budgets(spark, rows):
    return spark.createDataFrame(rows, "category string, monthly_limit double")


def test_budget_vs_actual_ok_and_over(spark, csv_ledger):
    ok = csv_ledger("Date,Narration,Debit Amount,Credit Amount\n2023-07-04,KFC BUCKET,460,0\n"
                    "2023-07-18,PIZZA NIGHT,290,0\n")
    r = budget.budget_vs_actual(ok, _budgets(spark, [("Food & Dining", 1000.0)]), "2023-07").first()
    assert (r.spent, r.remaining, r.utilization_pct, r.status) == (750.0, 250.0, 75.0, "ok")
    over = csv_ledger("Date,Narration,Debit Amount,Credit Amount\n2023-07-04,KFC BUCKET,700,0\n"
                      "2023-07-18,PIZZA NIGHT,450,0\n")
    r = budget.budget_vs_actual(over, _budgets(spark, [("Food & Dining", 1000.0)]), "2023-07").first()
    assert (r.spent, r.remaining, r.utilization_pct, r.status) == (1150.0, -150.0, 115.0, "over")


def test_budget_without_spend_and_zero_limit(spark, csv_ledger):
    led = csv_ledger(QUARTER)
    got = {r.category: (r.spent, r.utilization_pct, r.status) for r in budget.budget_vs_actual(
        led, _budgets(spark, [("Travel", 100.0), ("Shopping", 0.0)]), "2023-04").collect()}
    assert got == {"Travel": (0.0, 0.0, "ok"), "Shopping": (2400.0, 0.0, "over")}


def test_budget_log_upsert_and_delete(spark):
    t = dt.datetime
    log = budget.budget_log(spark, [
        ("Food & Dining", 5000, t(2024, 1, 1), "set"),
        ("Food & Dining", 7000, t(2024, 1, 2), "set"),
        ("Shopping", 3000, t(2024, 1, 1), "set"),
        ("Shopping", None, t(2024, 1, 3), "delete"),
        ("Travel", 100, t(2024, 1, 1), "set"),
        ("Travel", None, t(2024, 1, 2), "delete"),
        ("Travel", 200, t(2024, 1, 5), "set"),
    ])
    got = {r.category: (float(r.monthly_limit), r.created_at) for r in budget.current_budgets(log).collect()}
    assert got == {"Food & Dining": (7000.0, t(2024, 1, 1)), "Travel": (200.0, t(2024, 1, 5))}


def test_rule_allocation(spark, csv_ledger):
    r = budget.allocation_of(spark, 100000).first()
    assert (r.needs, r.wants, r.savings) == (50000.0, 30000.0, 20000.0)
    months = budget.rule_allocation(csv_ledger(AUTUMN)).collect()
    assert [(m.month, m.needs, m.wants, m.savings) for m in months] == [
        ("2023-08", 30000.0, 18000.0, 12000.0), ("2023-09", 30000.0, 18000.0, 12000.0)]


def test_spending_ratio(spark, csv_ledger):
    r = budget.spending_ratio(csv_ledger(AUTUMN)).first()
    assert (r.income, r.needs, r.wants, r.savings) == (120000.0, 900.0, 12950.0, 12000.0)
    assert (r.needs_pct, r.wants_pct, r.savings_pct) == (0.8, 10.8, 10.0)
    r3 = budget.spending_ratio(csv_ledger(QUARTER)).first()
    assert (r3.needs, r3.wants, r3.savings, r3.wants_pct, r3.savings_pct) == (0.0, 9780.0, 10500.0, 7.5, 8.0)


def test_spending_ratio_needs_plus_wants(spark):
    from finledger.plans.catalog import ledger_of
    from finledger.operators import summary
    led = ledger_of(spark, "/root/testdata/sf0.001")
    r = budget.spending_ratio(led).first()
    m = summary.monthly_breakdown(led).agg({"expenses": "sum"}).first()[0]
    assert round(r.needs + r.wants, 2) == round(m, 2)


def test_spending_ratio_no_income(spark, csv_ledger):
    led = csv_ledger("Date,Narration,Debit Amount,Credit Amount\n2023-07-04,KFC BUCKET,640,0\n")
    assert budget.spending_ratio(led).count() == 0


def test_discretionary(spark, csv_ledger):
    got = [(r.category, r.total, r.txn_count) for r in habits.discretionary(csv_ledger(AUTUMN)).collect()]
    assert got == [("Shopping", 6800.0, 2), ("Food & Dining", 5800.0, 3), ("Subscriptions", 350.0, 1)]
    got3 = [(r.category, r.total, round(r.avg_amount, 2)) for r in habits.discretionary(csv_ledger(QUARTER)).collect()]
    assert got3 == [("Shopping", 7500.0, 2500.0), ("Food & Dining", 2280.0, 760.0)]


def test_what_if(spark, csv_ledger):
    led = csv_ledger(AUTUMN)
    sc = habits.scenarios(spark, [("Food & Dining", 20.0), ("Nonexistent Category", 10.0)])
    rows = habits.what_if(led, sc).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.current_monthly_avg, r.monthly_saving, r.annual_saving, r.new_monthly_avg) == (2900.0, 580.0, 6960.0, 2320.0)


def test_subscription_audit(spark, csv_ledger):
    assert habits.subscription_audit(csv_ledger(AUTUMN)).count() == 0
    led = csv_ledger("Date,Narration,Debit Amount,Credit Amount\n2023-07-12,Hotstar Subscription,450,0\n"
                     "2023-08-12,Hotstar Subscription,450,0\n2023-08-11,gym recurring fee,900,0\n"
                     "2023-09-11,gym recurring fee,1000,0\n")
    got = {r.description: (r.occurrences, r.total_spent, r.first_seen, r.last_seen, r.estimated_annual)
           for r in habits.subscription_audit(led).collect()}
    assert got == {"Hotstar Subscription": (2, 900.0, "2023-07-12", "2023-08-12", 5400.0),
                   "gym recurring fee": (2, 1900.0, "2023-08-11", "2023-09-11", 11400.0)}


def test_suggestions(spark, csv_ledger):
    led = csv_ledger(AUTUMN)
    s = habits.suggestions(led, _budgets(spark, [("Food & Dining", 2000.0)]), "2023-09").collect()
    assert s and all(r.message for r in s)
    assert [r.priority for r in s] == sorted((r.priority for r in s), key=["high", "medium", "low"].index)
    types = [r.type for r in s]
    assert types[0] == "budget_overrun"
    assert s[0].potential_saving == 700.0
    assert "savings_low" in types
    disc = [r for r in s if r.type == "discretionary_spending"]
    assert [r.category for r in disc] == ["Shopping", "Food & Dining", "Subscriptions"]
    assert "48-hour rule" in disc[0].message and "(total: 6,800)" in disc[0].message
