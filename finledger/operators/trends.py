"""Trends over months.

Every window here runs over a pre-aggregated table (one row per key, month
and maybe category), never over ledger rows, so a hot account costs at most
its number of months in one task. Money stays an exact decimal until one
final division, and least squares uses exact sums, so results do not depend
on partitioning or summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finledger.functions.classify import display_category
from finledger.functions.text import cal_month_of
from finledger.operators._common import (
    as_double,
    credit,
    debit,
    key_window,
    mean_of,
    money_sum,
    present,
    r1,
    r2,
)
from finledger.operators.summary import monthly_totals
from finledger.taxonomy import MONTH_NAMES


def with_gaps_filled(monthly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Months without a row between a key's first and last calendar month, as zeros (months that are no ``YYYY-MM`` stay).

    Every calendar month also stands for the missing ones since the key's calendar month before it, so the rows are added where
    the key's rows are, after the one shuffle by key that the windows of a report need. That shuffle has a
    fixed number of partitions: small inputs that grow by their gaps are not merged into a few tasks.
    """
    if by:
        monthly = monthly.repartition(int(monthly.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    month, money = F.col("month"), ("income", "expenses", "savings")
    number = month.substr(1, 4).cast("int") * 12 + month.substr(6, 2).cast("int") - 1
    numbered = monthly.withColumn("_no", F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), number))
    before = F.last("_no", ignorenulls=True).over(key_window(by).orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    since = F.coalesce(F.col("_before") + 1, F.col("_no"))
    each = numbered.withColumn("_before", before).withColumn("_at", F.explode(F.when(F.col("_no").isNull(), F.array("_no")).otherwise(F.sequence(since, "_no"))))
    label = F.concat_ws("-", F.lpad(F.floor(F.col("_at") / 12).cast("string"), 4, "0"), F.lpad((F.col("_at") % 12 + 1).cast("string"), 2, "0"))
    zero = F.lit(0).cast("decimal(28,2)")
    value = lambda c: F.when(F.col("_at").isNull(), F.col(c)).when(F.col("_at") == F.col("_no"), F.coalesce(c, zero)).otherwise(zero)
    return each.select(*by, F.when(F.col("_at").isNull(), month).otherwise(label).alias("month"), *[value(c).alias(c) for c in money])


def monthly_trends(ledger: DataFrame, by: Sequence[str] = (), fill_gaps: bool = False) -> DataFrame:
    """A2 + W1-W3: 3- and 6-month moving averages of expenses over the months
    present (partial at the start), and the savings rate. ``fill_gaps`` counts
    calendar months without rows as zeros (decision D15)."""
    m = monthly_totals(ledger, by)
    if fill_gaps:
        m = with_gaps_filled(m, by)
    order = key_window(by).orderBy("month")
    w3, w6 = order.rowsBetween(-2, 0), order.rowsBetween(-5, 0)
    inc, sav = as_double("income"), as_double("savings")
    out = m.select(
        *by, "month",
        inc.alias("income"),
        as_double("expenses").alias("expenses"),
        sav.alias("savings"),
        r2(mean_of(F.sum("expenses").over(w3), F.count(F.lit(1)).over(w3))).alias("expense_ma3"),
        r2(mean_of(F.sum("expenses").over(w6), F.count(F.lit(1)).over(w6))).alias("expense_ma6"),
        r1(F.when(inc > 0, sav / inc * 100).otherwise(F.lit(0.0))).alias("savings_rate"),
    )
    return present(out, by, "month")


def anomalies(ledger: DataFrame, threshold_factor: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """A5 (+W4): (month, category) debit totals above ``factor`` x the category's
    average over the months where it occurs (the spike month included)."""
    mc = (
        ledger.where(debit())
        .groupBy(*by, "month", "category")
        .agg(money_sum().alias("total"))
        .select(*by, "month", display_category("category").alias("category"), "total")
    )
    w = key_window(by, "category")
    avg = mean_of(F.sum("total").over(w), F.count(F.lit(1)).over(w))
    scored = mc.select(*by, "month", "category", as_double("total").alias("t"), avg.alias("avg"))
    out = scored.where((F.col("avg") > 0) & (F.col("t") > F.col("avg") * F.lit(threshold_factor))).select(
        *by, "month", "category",
        r2("t").alias("amount"),
        r2("avg").alias("average"),
        r1((F.col("t") / F.col("avg") - 1) * 100).alias("spike_pct"),
    )
    return present(out, by, "month", "category")


def growth_rates(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A16 (+W5): per category, the months present split at n // 2; growth of the
    second half's sum over the first's; categories seen in one month are dropped."""
    mc = (
        ledger.where(debit() & F.col("category").isNotNull())
        .groupBy(*by, "category", "month")
        .agg(money_sum().alias("total"))
    )
    w_all = key_window(by, "category")
    pos = F.row_number().over(w_all.orderBy("month")) - 1
    n = F.count(F.lit(1)).over(w_all)
    ranked = mc.select(*by, "category", "total", pos.alias("pos"), n.alias("n"))
    first_half = F.col("pos") < F.floor(F.col("n") / 2)
    halves = ranked.where(F.col("n") >= 2).groupBy(*by, "category").agg(
        money_sum(first_half, "total").alias("first"),
        money_sum(~first_half, "total").alias("second"),
        F.max("n").alias("n"),
    )
    first, second = F.col("first"), F.col("second")
    growth = (
        F.when(first > 0, as_double(second - first) / as_double(first) * 100)
        .when(second > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
    out = halves.select(
        *by, "category",
        r1(growth).alias("growth_pct"),
        r2(as_double(second) / (F.col("n") - F.floor(F.col("n") / 2)).cast("double")).alias("recent_avg"),
    )
    return present(out, by, F.col("growth_pct").desc(), "category")


def seasonal_patterns(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A13 (+W6): debit spend by calendar month across years, against the mean
    of the calendar months present. ``avg_daily_spend`` is the average per
    transaction (the name is kept from the original report)."""
    cm = (
        ledger.where(debit())
        .groupBy(*by, cal_month_of("date").alias("cal_month"))
        .agg(money_sum().alias("total"), F.count(F.lit(1)).alias("txn_count"))
    )
    w = key_window(by)
    overall = mean_of(F.sum("total").over(w), F.count(F.lit(1)).over(w))
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    c = F.col("cal_month")
    # list indexing semantics: 1..12 name, 0 -> "", > 12 Unknown, negative counts from the end
    month_name = (
        F.when(c > 12, F.lit("Unknown"))
        .when(c >= 0, F.element_at(names, c + 1))
        .otherwise(F.element_at(names, c + 14))
    )
    out = cm.select(
        *by, "cal_month",
        month_name.alias("month_name"),
        r2(mean_of(F.col("total"), F.col("txn_count"))).alias("avg_daily_spend"),
        as_double("total").alias("total_spend"),
        F.col("txn_count").cast("long").alias("txn_count"),
        r1((as_double("total") / overall - 1) * 100).alias("vs_average_pct"),
    )
    return present(out, by, "cal_month")


def forecast(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A17 (+W7): least-squares line through monthly income and all-debit expenses
    (x = 0..n-1 over the months present), predicted at x = n, clamped at 0.
    Keys with fewer than 2 months produce no row."""
    m = ledger.groupBy(*by, "month").agg(
        money_sum(credit()).alias("income"),
        money_sum(debit()).alias("expenses"),
    )
    x = (F.row_number().over(key_window(by).orderBy("month")) - 1).cast("long")
    pts = m.select(*by, x.alias("x"), "income", "expenses")
    sums = pts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x").alias("sx"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum("income").alias("sy_i"), F.sum(F.col("income") * F.col("x")).alias("sxy_i"),
        F.sum("expenses").alias("sy_e"), F.sum(F.col("expenses") * F.col("x")).alias("sxy_e"),
    ).where(F.col("n") >= 2)

    n, sx, sxx = F.col("n"), F.col("sx"), F.col("sxx")
    den = (n * sxx - sx * sx).cast("double")

    def line(sy: str, sxy: str):
        slope_num = n * F.col(sxy) - sx * F.col(sy)                 # exact
        pred_num = slope_num * n + (F.col(sy) * sxx - sx * F.col(sxy))  # exact: (slope*n + intercept) * den
        return slope_num, as_double(slope_num) / den, as_double(pred_num) / den

    e_num, e_slope, e_pred = line("sy_e", "sxy_e")
    i_num, i_slope, i_pred = line("sy_i", "sxy_i")
    trend = lambda num: F.when(num > 0, F.lit("increasing")).otherwise(F.lit("decreasing"))
    return sums.select(
        *by,
        r2(F.greatest(F.lit(0.0), e_pred)).alias("forecast_expenses"),
        r2(F.greatest(F.lit(0.0), i_pred)).alias("forecast_income"),
        trend(e_num).alias("expense_trend"),
        trend(i_num).alias("income_trend"),
        r2(e_slope).alias("expense_change_per_month"),
        r2(i_slope).alias("income_change_per_month"),
        n.cast("long").alias("months_analyzed"),
    )
