"""Spending habits and suggestions.

Suggestions are the bag union of four small rule outputs over one fixed
schema, each computed from an aggregate of the ledger; the final order is
(priority, rule, position) so it is stable like the original list sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finledger.functions.text import filled
from finledger.operators._common import (
    as_double,
    debit,
    key_window,
    mean_of,
    money_sum,
    present,
    r2,
    salted_join,
)
from finledger.operators.budget import budget_status, ratio_report, ratio_sums
from finledger.operators.ledger import month_filter
from finledger.taxonomy import CATEGORY_TIPS, DEFAULT_TIP, DISCRETIONARY_CATEGORIES, SUGGESTION_MESSAGES

SUGGESTION_COLUMNS = ["priority", "category", "type", "message", "potential_saving"]


def discretionary(ledger: DataFrame, by: Sequence[str] = (), months: int | None = None) -> DataFrame:
    """Debit totals of the six discretionary categories, largest first.

    ``months`` counts only the newest so many months in which the key has such
    spending (decision D20); all history by default.
    """
    rows = ledger.where(debit() & F.col("category").isin(DISCRETIONARY_CATEGORIES))
    if months is None:
        agg = rows.groupBy(*by, "category").agg(money_sum().alias("total"), F.count(F.lit(1)).alias("txn_count"))
    else:
        per_month = rows.groupBy(*by, "category", "month").agg(money_sum().alias("m"), F.count(F.lit(1)).alias("n"))
        newest = F.dense_rank().over(key_window(by).orderBy(F.col("month").desc()))
        recent = per_month.withColumn("_age", newest).where(F.col("_age") <= months)
        agg = recent.groupBy(*by, "category").agg(F.sum("m").alias("total"), F.sum("n").alias("txn_count"))
    out = agg.select(
        *by, "category", as_double("total").alias("total"),
        F.col("txn_count").cast("long").alias("txn_count"),
        mean_of(F.col("total"), F.col("txn_count")).alias("avg_amount"),
    )
    return present(out, by, F.col("total").desc(), "category")


def type_label(col: str = "type") -> Column:
    """A suggestion's type as shown: ``budget_overrun`` -> ``Budget Overrun``."""
    return F.initcap(F.replace(F.col(col), F.lit("_"), F.lit(" ")))


def subscription_audit(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recurring payments grouped by raw description (>= 2 occurrences).

    A row qualifies when its category is Subscriptions or its description
    contains SUBSCRIPTION / RECURRING in any case.
    """
    subs = ledger.where(
        debit()
        & (
            (F.col("category") == "Subscriptions")
            | F.col("description").ilike("%SUBSCRIPTION%")
            | F.col("description").ilike("%RECURRING%")
        )
    )
    agg = subs.groupBy(*by, "description").agg(
        F.count(F.lit(1)).alias("occurrences"),
        money_sum().alias("total"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
    ).where(F.col("occurrences") >= 2)
    avg = mean_of(F.col("total"), F.col("occurrences"))
    out = agg.select(
        *by, "description",
        F.col("occurrences").cast("long").alias("occurrences"),
        as_double("total").alias("total_spent"),
        avg.alias("avg_amount"),
        "first_seen", "last_seen",
        r2(avg * 12).alias("estimated_annual"),
    )
    return present(out, by, F.col("total_spent").desc(), "description")


def subscription_total(audit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of recurring payments and their total estimated annual cost."""
    exact = F.sum(F.col("estimated_annual").cast("decimal(18,2)"))  # order-free sum of cent values
    return audit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("subscriptions"),
        exact.cast("double").alias("total_annual"),
    )


def scenarios(spark: SparkSession, rows: list[tuple[str, float]]) -> DataFrame:
    """What-if scenarios: (category, reduction_pct)."""
    return spark.createDataFrame(rows, "category string, reduction_pct double")


def what_if(ledger: DataFrame, scenario: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Savings from cutting a category by ``reduction_pct``.

    The monthly average is over the months *with* spend in the category.
    Scenarios whose category has no spend produce no row.
    """
    monthly = (
        ledger.where(debit()).groupBy(*by, "category", "month").agg(money_sum().alias("m"))
        .groupBy(*by, "category").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("months"))
        .where(F.col("total") != 0)
    )
    # the join key is a category: a plain shuffle join would send all accounts' rows of one category to one task
    wanted = scenario.select(F.col("category").alias("_category"), "reduction_pct")
    j = salted_join(monthly, wanted, [("category", "_category")], by)
    avg = mean_of(F.col("total"), F.col("months"))
    saving = avg * (F.col("reduction_pct") / 100)
    out = j.select(
        *by, "category",
        r2(avg).alias("current_monthly_avg"),
        F.col("reduction_pct"),
        r2(saving).alias("monthly_saving"),
        r2(saving * 12).alias("annual_saving"),
        r2(avg - saving).alias("new_monthly_avg"),
    )
    return present(out, by, "category", "reduction_pct")


def _fmt0(x):
    """``{:,.0f}``: thousands separators, no decimals."""
    return F.format_number(x, 0)


def tips_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CATEGORY_TIPS.items()), "category string, tip string")


def _suggestion_grain(ledger: DataFrame, month: str, by: Sequence[str]) -> DataFrame:
    """One aggregate feeds all four rules: ledger rows summed per (key, category,
    type, is_saving, in report month, subscription description). All rule
    inputs are sums, counts, minima or maxima of this grain, so the ledger is
    scanned once and its shuffle is reused by every rule."""
    sub = debit() & (
        (F.col("category") == "Subscriptions")
        | F.col("description").ilike("%SUBSCRIPTION%")
        | F.col("description").ilike("%RECURRING%")
    )
    return ledger.groupBy(
        *by, "category", "transaction_type", "is_saving",
        month_filter(month).alias("in_month"),
        F.when(sub, F.col("description")).alias("sub_desc"),
    ).agg(
        money_sum().alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
    )


def suggestions(ledger: DataFrame, budgets: DataFrame | None, month: str, by: Sequence[str] = (), positions: bool = False) -> DataFrame:
    """Budget overruns/warnings, top-3 discretionary with a tip, the
    subscription audit and the 50/30/20 checks, unioned and ordered by
    priority (stable; with ``positions`` the order is a column). Every rule reads one shared aggregate of the ledger."""
    spark = ledger.sparkSession
    parts = []
    null_money = F.lit(None).cast("double")
    grain = _suggestion_grain(ledger, month, by)

    if budgets is not None:
        spend = grain.where(debit() & F.col("in_month")).groupBy(*by, "category").agg(
            F.sum("total").alias("spent"))
        b = budget_status(spend, budgets, month, by).where(F.col("status").isin("over", "warning"))
        over = F.col("status") == "over"
        excess = r2(F.col("spent") - F.col("budget"))
        parts.append(b.select(
            *by,
            F.when(over, "high").otherwise("medium").alias("priority"),
            "category",
            F.when(over, "budget_overrun").otherwise("budget_warning").alias("type"),
            F.when(over, filled(SUGGESTION_MESSAGES["budget_overrun"], category=F.col("category"), excess=_fmt0(excess),
                                used=F.col("utilization_pct")))
            .otherwise(filled(SUGGESTION_MESSAGES["budget_warning"], category=F.col("category"), used=F.col("utilization_pct"),
                              remaining=_fmt0(F.col("remaining")))).alias("message"),
            F.when(over, excess).otherwise(null_money).alias("potential_saving"),
            F.lit(1).alias("rule_no"),
            F.col("utilization_pct").alias("seq_key"),
        ))

    d = (
        grain.where(debit() & F.col("category").isin(DISCRETIONARY_CATEGORIES))
        .groupBy(*by, "category").agg(as_double(F.sum("total")).alias("total"))
    )
    w = key_window(by).orderBy(F.col("total").desc(), "category")
    top = d.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= 3)
    tips = F.broadcast(tips_dimension(spark))  # fixed 8-row dimension
    top = top.join(tips, on="category", how="left")
    parts.append(top.select(
        *by, F.lit("medium").alias("priority"), "category",
        F.lit("discretionary_spending").alias("type"),
        filled(SUGGESTION_MESSAGES["discretionary_spending"], category=F.col("category"), total=_fmt0(F.col("total")),
               tip=F.coalesce(F.col("tip"), F.lit(DEFAULT_TIP))).alias("message"),
        null_money.alias("potential_saving"),
        F.lit(2).alias("rule_no"),
        (-F.col("pos")).cast("double").alias("seq_key"),
    ))

    audit = (
        grain.where(F.col("sub_desc").isNotNull())
        .groupBy(*by, "sub_desc").agg(F.sum("total").alias("total"), F.sum("n").alias("occurrences"))
        .where(F.col("occurrences") >= 2)
        .select(*by, r2(mean_of(F.col("total"), F.col("occurrences")) * 12).alias("estimated_annual"))
    )
    subs = subscription_total(audit, by).where(F.col("subscriptions") > 0)
    parts.append(subs.select(
        *by, F.lit("medium").alias("priority"), F.lit("Subscriptions").alias("category"),
        F.lit("subscription_audit").alias("type"),
        filled(SUGGESTION_MESSAGES["subscription_audit"], count=F.col("subscriptions"), annual=_fmt0(F.col("total_annual"))).alias("message"),
        r2(F.col("total_annual") * 0.2).alias("potential_saving"),
        F.lit(3).alias("rule_no"),
        F.lit(0.0).alias("seq_key"),
    ))

    ratio = ratio_report(ratio_sums(grain, by, "total"), by)
    rules = F.array(
        F.when(F.col("wants_pct") > 35, F.struct(
            F.lit("spending_ratio").alias("type"),
            filled(SUGGESTION_MESSAGES["spending_ratio"], wants=F.col("wants_pct")).alias("message"),
            F.lit(4).alias("rule_no"))),
        F.when(F.col("savings_pct") < 15, F.struct(
            F.lit("savings_low").alias("type"),
            filled(SUGGESTION_MESSAGES["savings_low"], savings=F.col("savings_pct")).alias("message"),
            F.lit(5).alias("rule_no"))),
    )
    checks = ratio.select(*by, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    parts.append(checks.select(
        *by, F.lit("high").alias("priority"), F.lit("Overall").alias("category"),
        F.col("r.type").alias("type"), F.col("r.message").alias("message"),
        null_money.alias("potential_saving"),
        F.col("r.rule_no").alias("rule_no"),
        F.lit(0.0).alias("seq_key"),
    ))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    out = out.withColumn("priority_rank", rank)
    order = ["priority_rank", "rule_no", F.col("seq_key").desc(), "category"]
    out = out.select(*by, *SUGGESTION_COLUMNS, "priority_rank", "rule_no", "seq_key")
    if positions:
        # a key has a handful of suggestions and a budget message for each category
        out = out.withColumn("position", F.row_number().over(key_window(by).orderBy(*order)).cast("long"))
    return present(out, by, *order).drop("seq_key")
