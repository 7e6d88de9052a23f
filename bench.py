"""Benchmark: ingest and every ledger operator, globally and per account, at one scale factor.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3). Each query runs once as warm-up, then BENCH_RUNS times;
the median is reported. Results go to the ``noop`` sink. Prints ONE JSON line
with cores and memory beside the timings.

Two ledgers are ingested and stored as Parquet partitioned by month (the way
a deployment keeps it): statements of every order (accounts = customers) and,
for volume, of every line item (accounts = suppliers). The analytics read the
stored line-item ledger, globally (``by=()``) and per account.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from finledger.operators import budget, corrections, festivals, habits, ingest, ledger as rows, ml, summary, trends  # noqa: E402
from finledger.plans.fixtures import AS_OF, CORRECTION_RULES, SCENARIOS, budget_log_from_history  # noqa: E402
from finledger.session import fresh_dir, local_session, prepare_session  # noqa: E402
from finledger.sources.csv import export_csv, read_statement_csv  # noqa: E402
from finledger.sources.store import append_new, read_ledger, write_batch  # noqa: E402
from finledger.sources.derived import (  # noqa: E402
    derive_statements,
    lineitem_statements,
    orders_statements,
    read_table,
    spread,
)
from finledger.streaming import ingest_stream as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

ACCT = ("account_id",)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, max(8, cpus * 2), app="finledger-bench")
    prepare_session(spark)
    base = fresh_dir(spark, "bench")

    def new_path(name):
        return f"{base}/{name}-{time.time_ns()}"

    def store(statements, name):
        path = new_path(name)
        write_batch(ingest.build_ledger(statements), path)
        return path

    timings: dict[str, float] = {}

    def measure(name, fn, n=runs, warm=True):
        if warm:
            fn()
        ts = []
        for _ in range(n):
            t0 = time.perf_counter()
            fn()
            ts.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(ts), 3)

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    # ---------------------------------------------------------------- ingest and storage
    measure("ingest_orders", lambda: store(orders_statements(spark, sf_dir), "orders"))
    measure("ingest_lineitem", lambda: store(lineitem_statements(spark, sf_dir), "lineitem"))
    path = store(lineitem_statements(spark, sf_dir), "lineitem-final")
    led = read_ledger(spark, path)
    orders = orders_statements(spark, sf_dir)
    measure("ingest_report", lambda: sink(ingest.ingest_report(orders)))

    def append_again():
        p = store(orders_statements(spark, sf_dir), "append")
        t0 = time.perf_counter()
        append_new(spark, ingest.prepare_transactions(orders_statements(spark, sf_dir)), p)
        return time.perf_counter() - t0

    append_again()
    timings["append_all_known"] = round(statistics.median(append_again() for _ in range(runs)), 3)

    csv_dir = new_path("csv")
    orders.select(F.col("account_id").alias("Account"), F.col("date_text").alias("Date"), F.col("narration").alias("Narration"),
                  F.col("debit_text").alias("Debit Amount"), F.col("credit_text").alias("Credit Amount")).write.option("header", True).csv(csv_dir)
    measure("csv_scan", lambda: sink(read_statement_csv(spark, csv_dir, account_column="Account")))
    measure("export_csv", lambda: export_csv(led, new_path("export")), n=1)

    def stream():
        p = new_path("stream")
        src = spark.readStream.schema(spark.read.parquet(csv_source).schema).parquet(csv_source)
        st.start_ingest(src, f"{p}/ledger", f"{p}/ck").awaitTermination()
        st.start_daily_totals(spark, f"{p}/ledger", f"{p}/days", f"{p}/ck2").awaitTermination()
        sink(st.daily_totals(spark, f"{p}/days"))

    csv_source = new_path("lines")
    orders.write.parquet(csv_source)
    measure("stream_ingest_and_daily_totals", stream, n=1)

    # ---------------------------------------------------------------- analytics over the stored ledger
    fest = festivals.festivals_table(spark)
    month = "1996-03"
    scenario = habits.scenarios(spark, SCENARIOS)
    corr = corrections.rule_corrections(led, CORRECTION_RULES)
    for by, suffix in (((), ""), (ACCT, "_by_account")):
        cur = budget.current_budgets(budget_log_from_history(led, by), by)
        for name, q in {
            "summary": lambda: summary.summary(led, by),
            "monthly_breakdown": lambda: summary.monthly_breakdown(led, by),
            "category_breakdown": lambda: summary.category_breakdown(led, "Debit", by),
            "category_month": lambda: summary.category_month(led, by),
            "daily_spending": lambda: summary.daily_spending(led, 3, by),
            "spending_heatmap": lambda: summary.spending_heatmap(led, 6, by),
            "monthly_trends": lambda: trends.monthly_trends(led, by),
            "anomalies": lambda: trends.anomalies(led, 1.5, by),
            "growth_rates": lambda: trends.growth_rates(led, by),
            "seasonal": lambda: trends.seasonal_patterns(led, by),
            "forecast": lambda: trends.forecast(led, by),
            "budgets_current": lambda: budget.current_budgets(budget_log_from_history(led, by), by),
            "budget_vs_actual": lambda: budget.budget_vs_actual(led, cur, month, by),
            "spending_ratio": lambda: budget.spending_ratio(led, by),
            "rule_allocation": lambda: budget.rule_allocation(led, by),
            "discretionary": lambda: habits.discretionary(led, by),
            "subscription_audit": lambda: habits.subscription_audit(led, by),
            "what_if": lambda: habits.what_if(led, scenario, by),
            "suggestions": lambda: habits.suggestions(led, cur, month, by=by),
            "festival_history": lambda: festivals.festival_history(led, fest, by),
            "upcoming_festivals": lambda: festivals.upcoming_festivals(led, fest, AS_OF, 90, by=by),
            "festive_vs_normal": lambda: festivals.festive_vs_normal(led, fest, by),
        }.items():
            measure(name + suffix, lambda q=q: sink(q()))
    for name, q in {
        "month_slice": lambda: rows.month_slice(led, month),
        "ledger_page": lambda: rows.ledger_page(led, 500, 100),
        "search": lambda: rows.search(led, transaction_type="Debit", text="prime"),
        "uncategorized": lambda: rows.uncategorized(led),
        "corrections_applied": lambda: corrections.apply_corrections(led, corr),
        "training_bag": lambda: corrections.weighted_bag(corrections.training_bag(led, corr)),
    }.items():
        measure(name, lambda q=q: sink(q()))

    # ---------------------------------------------------------------- text models
    bag = corrections.training_bag(led, corr)
    t0 = time.perf_counter()
    models = ml.train(bag)
    timings["ml_train"] = round(time.perf_counter() - t0, 3)
    texts = led.where(F.col("category").isNull()).select("processed").distinct()
    measure("ml_score", lambda: sink(models.score(texts, "processed")), n=1)

    # ---------------------------------------------------------------- one account holds a third of all line items
    def skewed_statements():
        li = spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey")
        return derive_statements(
            li, account=F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_suppkey")),
            seq=F.col("l_orderkey") * 8 + F.col("l_linenumber"),
            idx=(F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 26,
            day=F.col("l_shipdate"), price=F.col("l_extendedprice"))

    measure("ingest_lineitem_skewed", lambda: store(skewed_statements(), "skewed"))
    skewed = read_ledger(spark, store(skewed_statements(), "skewed-final"))
    for name, q in {
        "monthly_trends_by_account_skewed": lambda: trends.monthly_trends(skewed, ACCT),
        "anomalies_by_account_skewed": lambda: trends.anomalies(skewed, 1.5, ACCT),
        "forecast_by_account_skewed": lambda: trends.forecast(skewed, ACCT),
        "daily_spending_by_account_skewed": lambda: summary.daily_spending(skewed, 3, ACCT),
    }.items():
        measure(name, lambda q=q: sink(q()))

    print(json.dumps({
        "metric": "finledger_total_median_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": cpus,
        "driver_memory": spark.sparkContext.getConf().get("spark.driver.memory", "default"),
        "runs": runs,
        "ledger_rows": led.count(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
