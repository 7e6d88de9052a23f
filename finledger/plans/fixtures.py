"""Fixed inputs of the registered queries and the bench.

Small user inputs (what-if scenarios, correction rules, the report date) and
the budget change log a user could have produced from their own history.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AS_OF = dt.datetime(2001, 10, 5, 12, 0, 0)
DAYS_AHEAD = 90

SCENARIOS = [("Food & Dining", 20.0), ("Shopping", 10.0), ("Subscriptions", 50.0), ("Travel", 15.0),
             ("Nonexistent Category", 10.0)]

CORRECTION_RULES = {
    "RANDOM MERCHANT": ("Shopping", 0),
    "GYM RECURRING FEE": ("Personal Care", 0),
    "MISC DEPOSIT": ("Transfer In", 0),
}


def budget_log_from_history(ledger: DataFrame, by=()) -> DataFrame:
    """A budget change log a user could have produced: at the start of every
    month each spent category's budget is set to that month's debit total,
    and one day after its first budget the category's budget was deleted."""
    start = F.try_to_date(F.concat(F.col("month"), F.lit("-01")), "yyyy-MM-dd")
    monthly = (
        ledger.where((F.col("transaction_type") == "Debit") & F.col("category").isNotNull() & start.isNotNull())
        .groupBy(*by, "category", "month")
        .agg(F.sum("amount").cast("decimal(18,2)").alias("monthly_limit"))
        .withColumn("event_time", F.try_to_date(F.concat(F.col("month"), F.lit("-01")), "yyyy-MM-dd").cast("timestamp"))
    )
    sets = monthly.select(*by, "category", "monthly_limit", "event_time", F.lit("set").alias("op"))
    deletes = monthly.groupBy(*by, "category").agg(
        (F.min("event_time") + F.expr("INTERVAL 1 DAY")).alias("event_time")
    ).select(*by, "category", F.lit(None).cast("decimal(18,2)").alias("monthly_limit"), "event_time",
             F.lit("delete").alias("op"))
    return sets.unionByName(deletes)


def festival_events(orders: DataFrame) -> DataFrame:
    """A festival change log of many restarts and edits, one event for each order: which festival, what and when follows from the order."""
    k = F.col("o_orderkey")
    op = F.when(k % 7 == 0, F.lit("remove")).when(k % 7 < 3, F.lit("add")).otherwise(F.lit("seed"))
    return orders.select(
        F.concat(F.lit("Festival "), (F.col("o_custkey") % 400).cast("string")).alias("name"),
        (F.col("o_custkey") % 12 + 1).cast("int").alias("month"), (F.col("o_custkey") % 28 + 1).cast("int").alias("day"),
        (k % 5 + 1).cast("int").alias("duration_days"), op.alias("op"), F.col("o_orderdate").cast("timestamp").alias("event_time"), k.alias("event_seq"))
