"""Festival calendar, history, upcoming alerts and festive vs normal months (A14, A15, R2-R4, M3, IO10)."""

import datetime as dt

from conftest import FESTIVE_YEAR
from finledger.operators import festivals as fest

AS_OF = dt.datetime(2001, 10, 5, 12, 0, 0)


def _table(spark, rows):
    return fest.festivals_table(spark, [(i + 1, n, m, d, 1, 1) for i, (n, m, d) in enumerate(rows)])


def test_defaults_seeded_once(spark):
    defaults = fest.festivals_table(spark)
    assert {r.name for r in fest.active_festivals(defaults).collect()} >= {"Diwali", "Christmas"}
    assert fest.seed_festivals(defaults, defaults).count() == 0          # restart adds nothing
    removed = fest.remove_festival(defaults, 1)
    assert "Diwali" not in {r.name for r in fest.active_festivals(removed).collect()}
    assert fest.seed_festivals(removed, defaults).count() == 0          # and does not revive it


def test_add_festival(spark):
    t = fest.add_festival(fest.festivals_table(spark), "Pongal", 1, 15, 4)
    assert "Pongal" in {r.name for r in fest.active_festivals(t).collect()}


def test_upcoming_both_modes(spark, csv_ledger):
    led = csv_ledger(FESTIVE_YEAR)
    table = _table(spark, [("A", 10, 6), ("B", 10, 5), ("C", 10, 8), ("D", 1, 15), ("E", 2, 29)])
    by_date = {r.name: (r.date, r.days_until) for r in fest.upcoming_festivals(led, table, AS_OF, 365, "date").collect()}
    assert by_date == {"A": ("2001-10-06", 1), "B": ("2001-10-05", 0), "C": ("2001-10-08", 3),
                       "D": ("2002-01-15", 102)}
    ref = {r.name: (r.date, r.days_until) for r in fest.upcoming_festivals(led, table, AS_OF, 365, "reference").collect()}
    assert ref == {"A": ("2001-10-06", 0), "B": ("2002-10-05", 364), "C": ("2001-10-08", 2),
                   "D": ("2002-01-15", 101)}


def test_upcoming_window_and_message(spark, csv_ledger):
    led = csv_ledger(FESTIVE_YEAR)
    table = _table(spark, [("Diwali", 10, 20), ("Christmas", 12, 25), ("Today", 10, 5), ("Tomorrow", 10, 6)])
    rows = {r.name: r for r in fest.upcoming_festivals(led, table, AS_OF, 21).collect()}
    assert set(rows) == {"Diwali", "Today", "Tomorrow"}
    assert rows["Today"].message.startswith("Today is today!")
    assert rows["Tomorrow"].message.startswith("Tomorrow is tomorrow!")
    d = rows["Diwali"]
    assert d.days_until == 15 and d.urgency == "info" and d.banner == "warning"
    # October history: 11400 in one month vs 5050 over all four months
    assert d.historical_avg_spend == 11400.0
    assert d.message == ("Diwali is in 15 days! Based on your history, you typically spend around ₹11,400 "
                         "during this period (₹6,350 more than normal months). Consider saving ₹6,985 extra.")
    assert rows["Today"].urgency == "danger"


def test_history_without_data(spark, csv_ledger):
    led = csv_ledger(FESTIVE_YEAR)
    h = {r.name: (r.avg_spend, r.extra_spend, r.suggested_saving)
         for r in fest.festival_history(led, _table(spark, [("April", 4, 1), ("Oct", 10, 1)])).collect()}
    assert h == {"April": (0.0, 0.0, 0.0), "Oct": (11400.0, 6350.0, 6985.0)}


def test_festive_vs_normal(spark, csv_ledger):
    r = fest.festive_vs_normal(csv_ledger(FESTIVE_YEAR), _table(spark, [("Diwali", 10, 20), ("Christmas", 12, 25)])).first()
    assert (r.festive_months_avg, r.normal_months_avg, r.difference, r.difference_pct) == (8300.0, 1800.0, 6500.0, 361.1)
    assert (r.festive_months_count, r.normal_months_count, r.monthly_set_aside) == (2, 2, 541.67)


def test_festive_vs_normal_empty(spark, csv_ledger):
    led = csv_ledger("Date,Narration,Debit Amount,Credit Amount\n2023-07-05,PAYROLL,0,100\n")
    assert fest.festive_vs_normal(led, fest.festivals_table(spark)).count() == 0


def test_change_log_of_festivals(spark):
    t = lambda d: dt.datetime(2001, 1, d)
    events = [("Kept", 1, 1, 2, "seed", t(1), 1), ("Kept", 1, 1, 9, "seed", t(2), 2),
              ("Gone", 1, 2, 1, "seed", t(1), 3), ("Gone", 1, 2, 1, "remove", t(3), 4), ("Gone", 1, 2, 1, "seed", t(4), 5),
              ("Back", 1, 2, 1, "remove", t(1), 6), ("Back", 1, 2, 3, "add", t(2), 7),
              ("Tie", 1, 1, 4, "add", t(5), 8), ("Tie", 1, 1, 5, "remove", t(5), 9), ("Own", 2, 1, None, "add", t(1), 10)]
    now = fest.current_festivals(spark.createDataFrame(events, fest.FESTIVAL_EVENT_SCHEMA)).orderBy("position").collect()
    assert [tuple(r) for r in now] == [("Kept", 1, 1, 2, 1), ("Back", 1, 2, 3, 2), ("Own", 2, 1, None, 3)]
    assert fest.current_festivals(spark.createDataFrame([], fest.FESTIVAL_EVENT_SCHEMA)).collect() == []
