"""Budgets and spending split.

The budget table is a change log (set / delete events); the current budget
per category is the latest event. Budget vs actual joins the current
budgets to one aggregate of the month's debit spend (one query, not one per
budget).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finledger.operators._common import as_double, credit, debit, money_sum, present, r1, r2
from finledger.operators.ledger import month_filter
from finledger.operators.summary import monthly_totals
from finledger.taxonomy import ALLOCATION_DESCRIPTIONS, NEEDS_CATEGORIES

BUDGET_LOG_SCHEMA = "category string, monthly_limit decimal(18,2), event_time timestamp, op string"


def budget_log(spark: SparkSession, events: list[tuple]) -> DataFrame:
    """A budget change log from (category, monthly_limit, event_time, op) tuples."""
    rows = [(c, None if lim is None else float(lim), t, op) for c, lim, t, op in events]
    df = spark.createDataFrame(rows, "category string, monthly_limit double, event_time timestamp, op string")
    return df.withColumn("monthly_limit", F.col("monthly_limit").cast("decimal(18,2)"))


def current_budgets(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M1/M2: the current budget per (key, category) from a change log.

    The latest event wins; a ``delete`` as latest event removes the budget.
    ``created_at`` is the first ``set`` after the last ``delete`` (an upsert
    keeps it, a re-create after delete starts it again).
    """
    keys = [*by, "category"]
    # two aggregates and a join: no window ever holds the whole history of a category
    ends = log.where(F.col("op") == "delete").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("event_time").alias("last_delete"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    live = log.join(ends, same, "left").where(
        F.col("last_delete").isNull() | (F.col("event_time") > F.col("last_delete"))
    )
    latest = F.max_by(F.struct("monthly_limit", "op"), F.col("event_time"))
    cur = live.groupBy(*keys).agg(
        latest.alias("latest"),
        F.min(F.when(F.col("op") == "set", F.col("event_time"))).alias("created_at"),
        F.max("event_time").alias("updated_at"),
    )
    return cur.where(F.col("latest.op") == "set").select(
        *keys, F.col("latest.monthly_limit").alias("monthly_limit"), "created_at", "updated_at"
    )


def budget_vs_actual(ledger: DataFrame, budgets: DataFrame, month: str | None, by: Sequence[str] = ()) -> DataFrame:
    """A12 + J1: spend of ``month`` (None: of all months) per budget category against its limit.

    spent = debit total of the category in the month (savings included, 0 if
    none); utilization = spent/limit (0 when the limit is not positive);
    status: over (> limit), warning (> 80%), else ok. ``budgets`` must carry
    the ``by`` keys when ``by`` is given.
    """
    missing = [k for k in by if k not in budgets.columns]
    if missing:
        raise ValueError(f"budgets need the key columns {missing} for a per-key report")
    keys = [*by, "category"]
    spend = (
        ledger.where(debit() if month is None else debit() & month_filter(month))
        .groupBy(*keys)
        .agg(money_sum().alias("spent"))
    )
    return budget_status(spend, budgets, month, by)


def budget_status(spend: DataFrame, budgets: DataFrame, month: str | None, by: Sequence[str] = ()) -> DataFrame:
    """A12 from a month's (key, category, spent) aggregate and the current budgets."""
    keys = [*by, "category"]
    b = budgets.select(*keys, F.col("monthly_limit").cast("decimal(18,2)").alias("limit"))
    # the budget side is at most one row per (key, category); AQE broadcasts it when small
    j = b.join(spend, on=keys, how="left")
    spent = F.coalesce(F.col("spent"), F.lit(0).cast("decimal(18,2)"))
    lim = F.col("limit")
    util = F.when(lim > 0, as_double(spent) / as_double(lim) * 100).otherwise(F.lit(0.0))
    out = j.select(
        *keys,
        F.lit(month).cast("string").alias("month"),
        as_double(lim).alias("budget"),
        as_double(spent).alias("spent"),
        as_double(lim - spent).alias("remaining"),
        r1(util).alias("utilization_pct"),
        F.when(spent > lim, F.lit("over"))
        .when(spent > lim * F.lit(0.8).cast("decimal(2,1)"), F.lit("warning"))
        .otherwise(F.lit("ok")).alias("status"),
    )
    return present(out, by, F.col("utilization_pct").desc(), "category")


def budget_status_top(status: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most used budgets with utilisation capped at 100 for bars."""
    capped = status.withColumn("bar_pct", F.least(F.col("utilization_pct"), F.lit(100.0)))
    if not by:
        return capped.orderBy(F.col("utilization_pct").desc(), "category").limit(k)
    w = Window.partitionBy(*by).orderBy(F.col("utilization_pct").desc(), "category")
    return capped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def spending_ratio(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A10: 50/30/20 analysis in one conditional-sum pass.

    needs = non-saving debits in the needs categories; wants = the other
    non-saving debits (uncategorised included); percentages of income. Keys
    with no positive income produce no row.
    """
    return ratio_report(ratio_sums(ledger, by), by)


def ratio_sums(rows: DataFrame, by: Sequence[str] = (), amount: str = "amount") -> DataFrame:
    """A10 sums (income, expenses, savings, needs) of ledger rows or of pre-summed rows."""
    non_saving_debit = debit() & (F.col("is_saving") == 0)
    return rows.groupBy(*by).agg(
        money_sum(credit(), amount).alias("income"),
        money_sum(non_saving_debit, amount).alias("expenses"),
        money_sum(F.col("is_saving") == 1, amount).alias("savings"),
        money_sum(non_saving_debit & F.col("category").isin(NEEDS_CATEGORIES), amount).alias("needs"),
    )


def ratio_report(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A10 report from :func:`ratio_sums`; keys without positive income give no row."""
    agg = sums.where(F.col("income") > 0)
    inc = as_double("income")
    wants = F.col("expenses") - F.col("needs")
    pct = lambda x: r1(as_double(x) / inc * 100)
    return agg.select(
        *by,
        inc.alias("income"),
        as_double("needs").alias("needs"),
        as_double(wants).alias("wants"),
        as_double("savings").alias("savings"),
        pct(F.col("needs")).alias("needs_pct"),
        pct(wants).alias("wants_pct"),
        pct(F.col("savings")).alias("savings_pct"),
        F.lit(50).alias("ideal_needs_pct"),
        F.lit(30).alias("ideal_wants_pct"),
        F.lit(20).alias("ideal_savings_pct"),
    )


def rule_allocation(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The 50/30/20 allocation of each month's income (needs, wants, savings)."""
    m = monthly_totals(ledger, by)
    inc = F.col("income")
    part = lambda f: r2(as_double(inc * F.lit(f).cast("decimal(2,1)")))
    out = m.select(
        *by, "month", as_double(inc).alias("income"),
        part("0.5").alias("needs"), part("0.3").alias("wants"), part("0.2").alias("savings"),
    )
    return present(out, by, "month")


def allocation_of(spark: SparkSession, monthly_income: float) -> DataFrame:
    """A11 for one figure, as in the original helper (one row)."""
    return spark.createDataFrame([(float(monthly_income),)], "income double").select(
        "income",
        r2(F.col("income") * 0.5).alias("needs"),
        r2(F.col("income") * 0.3).alias("wants"),
        r2(F.col("income") * 0.2).alias("savings"),
        F.lit(ALLOCATION_DESCRIPTIONS["needs"]).alias("needs_description"),
        F.lit(ALLOCATION_DESCRIPTIONS["wants"]).alias("wants_description"),
        F.lit(ALLOCATION_DESCRIPTIONS["savings"]).alias("savings_description"),
    )
