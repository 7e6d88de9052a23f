"""Totals and breakdowns.

Each is a single aggregate with map-side partial combining; the shuffle
carries one row per (key, group) per map task, never ledger rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finledger.operators._common import as_double, credit, debit, money_sum, present

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


ISO_WEEKS = range(1, 54)


def summary(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A1 + A1b + A18: income (credits), expenses (ALL debits, savings included),
    savings (is_saving=1 of any type), count, net position, uncategorised count."""
    agg = ledger.groupBy(*by).agg(
        money_sum(credit()).alias("income"),
        money_sum(debit()).alias("expenses"),
        money_sum(F.col("is_saving") == 1).alias("savings"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.coalesce(F.col("category"), F.lit("")) == "").alias("uncategorized_count"),
    )
    zero = F.lit(0).cast("decimal(18,2)")
    inc, exp, sav = (F.coalesce(F.col(c), zero) for c in ("income", "expenses", "savings"))
    return agg.select(
        *by,
        as_double(inc).alias("total_income"),
        as_double(exp).alias("total_expenses"),
        as_double(sav).alias("total_savings"),
        F.col("total_count").cast("long").alias("total_count"),
        as_double(inc - exp).alias("net_position"),
        F.col("uncategorized_count").cast("long").alias("uncategorized_count"),
    )


def monthly_totals(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A2 with exact decimal sums: income, expenses (debits that are not savings), savings."""
    return ledger.groupBy(*by, "month").agg(
        money_sum(credit()).alias("income"),
        money_sum(debit() & (F.col("is_saving") == 0)).alias("expenses"),
        money_sum(F.col("is_saving") == 1).alias("savings"),
    )


def monthly_breakdown(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A2 report (doubles), ordered by month."""
    m = monthly_totals(ledger, by)
    out = m.select(*by, "month", *[as_double(c).alias(c) for c in ("income", "expenses", "savings")])
    return present(out, by, "month")


def category_breakdown(ledger: DataFrame, transaction_type: str | None = None,
                       by: Sequence[str] = ()) -> DataFrame:
    """A3: total per category (null category is its own group), largest first."""
    rows = ledger if transaction_type is None else ledger.where(F.col("transaction_type") == transaction_type)
    out = rows.groupBy(*by, "category").agg(as_double(money_sum()).alias("total"))
    return present(out, by, F.col("total").desc(), F.col("category").asc_nulls_first())


def _daily_totals(ledger: DataFrame, months_back: int, by: Sequence[str]) -> DataFrame:
    """Exact debit total per date for the newest ``months_back*31`` dates with spending."""
    n = months_back * 31
    daily = ledger.where(debit()).groupBy(*by, "date").agg(money_sum().alias("total"))
    if not by:
        return daily.orderBy(F.col("date").desc()).limit(n)
    w = Window.partitionBy(*by).orderBy(F.col("date").desc())
    return daily.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")


def daily_spending(ledger: DataFrame, months_back: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """A4: debit total per date for the newest ``months_back*31`` dates that have spending.

    This is a top-k report (the limit is the feature). Globally it is a
    TakeOrderedAndProject; per key a row_number over the daily aggregate.
    """
    days = _daily_totals(ledger, months_back, by)
    return days.select(*by, "date", as_double("total").alias("total"))


def spending_heatmap(ledger: DataFrame, months_back: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """A4b long form: weekday x ISO week totals of the daily spending window.

    The year is ignored (week 5 of two years adds up); dates that did not
    parse are dropped. Monday first via ``weekday_no``. Cells add exact
    decimals, so the result does not depend on summation order.
    """
    days = _daily_totals(ledger, months_back, by)
    d = F.try_to_date(F.col("date"), "yyyy-MM-dd")
    cells = days.where(d.isNotNull()).select(
        *by,
        F.date_format(d, "EEEE").alias("weekday"),
        ((F.dayofweek(d) + 5) % 7).alias("weekday_no"),
        F.weekofyear(d).alias("week"),
        "total",
    )
    out = cells.groupBy(*by, "weekday", "weekday_no", "week").agg(as_double(F.sum("total")).alias("total"))
    return present(out, by, "weekday_no", "week")


def heatmap_matrix(heatmap_long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A4b as the chart wants it: one row per weekday, one column per ISO week (``week_1`` to ``week_53``), 0-filled.

    The weeks are a fixed domain, so no job looks for the columns.
    """
    wide = heatmap_long.groupBy(*by, "weekday_no", "weekday").pivot("week", list(ISO_WEEKS)).agg(F.sum("total"))
    cells = [F.coalesce(F.col(f"`{w}`"), F.lit(0.0)).alias(f"week_{w}") for w in ISO_WEEKS]
    return present(wide.select(*by, "weekday_no", "weekday", *cells), by, "weekday_no")


def category_month(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Debit total per (month, category) for categorised rows."""
    out = (
        ledger.where(debit() & F.col("category").isNotNull())
        .groupBy(*by, "month", "category")
        .agg(as_double(money_sum()).alias("total"))
    )
    return present(out, by, "month", "category")
