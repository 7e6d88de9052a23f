"""Registered queries: each reads the driver's tables and runs one operator.

Every query takes ``(spark, sf_dir)``. The ledger is derived from all of
``orders`` (see :mod:`finledger.sources.derived`) and ingested exactly as a
statement upload would be; the analytics then run over the whole ledger.
``SQL`` holds the DuckDB oracle of each query over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finledger.functions.classify import keyword_category, label_group_of
from finledger.functions.text import normalize_description, parse_date, txn_hash
from finledger.operators import ingest, ledger as rows, summary, trends
from finledger.plans import oracle as O
from finledger.session import prepare_session
from finledger.sources.derived import orders_statements
from finledger.taxonomy import ALL_EXPENSE_CATEGORIES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ACCT = ("account_id",)
AS_OF_MONTH = "1996-03"   # fixed report month inside the data range


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_session(spark)
    return orders_statements(spark, sf_dir)


def ledger_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified, de-duplicated ledger of every derived statement line."""
    return ingest.build_ledger(statements(spark, sf_dir))


# ---------------------------------------------------------------- C1-C5, IO2


@register("normalize_descriptions", O.over_ledger(
    "SELECT account_id, row_seq, description AS narration, processed FROM parsed"))
def q_normalize(spark, sf_dir):
    st = statements(spark, sf_dir)
    return st.select("account_id", "row_seq", "narration", normalize_description("narration").alias("processed"))


@register("parse_dates", O.over_ledger("SELECT account_id, row_seq, date_text, date FROM parsed"))
def q_parse_dates(spark, sf_dir):
    st = statements(spark, sf_dir)
    return st.select("account_id", "row_seq", "date_text", parse_date("date_text").alias("date"))


@register("keyword_labels", O.over_ledger(
    "SELECT account_id, row_seq, processed, kw_category AS category, "
    "CASE WHEN kw_category IN " + O._in_list(ALL_EXPENSE_CATEGORIES) +
    " THEN 'Expense' WHEN kw_category IN " + O.SAVINGS_IN + " THEN 'Savings/Investment' "
    "WHEN kw_category IS NOT NULL THEN 'Income' END AS label_group FROM lines"))
def q_keyword_labels(spark, sf_dir):
    st = statements(spark, sf_dir)
    p = st.select("account_id", "row_seq", normalize_description("narration").alias("processed"))
    cat = keyword_category(F.col("processed"))
    return p.select("account_id", "row_seq", "processed", cat.alias("category"),
                    label_group_of(cat).alias("label_group"))


@register("classify_keywords", O.over_ledger(
    "SELECT account_id, row_seq, date, " + O.dbl("amount") + " AS amount, transaction_type, category, is_saving "
    "FROM classified"))
def q_classify(spark, sf_dir):
    tx = ingest.prepare_transactions(statements(spark, sf_dir))
    return tx.select("account_id", "row_seq", "date", F.col("amount").cast("double").alias("amount"),
                     "transaction_type", "category", "is_saving")


@register("txn_hash", O.over_ledger("SELECT account_id, row_seq, hash FROM hashed"))
def q_txn_hash(spark, sf_dir):
    tx = ingest.prepare_transactions(statements(spark, sf_dir))
    return tx.select("account_id", "row_seq",
                     txn_hash("date", "processed", "amount", "transaction_type").alias("hash"))


# ---------------------------------------------------------------- IO3, IO5

LEDGER_SELECT = (
    "SELECT account_id, row_seq, date, month, description, processed, " + O.dbl("amount") +
    " AS amount, transaction_type, category, is_saving, hash FROM ledger")


@register("ingest_dedup", O.over_ledger(LEDGER_SELECT))
def q_ingest_dedup(spark, sf_dir):
    led = ledger_of(spark, sf_dir)
    return led.select("account_id", "row_seq", "date", "month", "description", "processed",
                      F.col("amount").cast("double").alias("amount"), "transaction_type", "category",
                      "is_saving", "hash")


@register("ingest_report", O.over_ledger(
    "SELECT (SELECT count(*) FROM statement) AS total_rows, "
    "(SELECT count(*) FROM ledger) AS inserted, "
    "(SELECT count(*) FROM classified) - (SELECT count(*) FROM ledger) AS skipped, "
    "(SELECT count(*) FROM lines WHERE amount IS NULL) AS dropped, "
    "(SELECT count(*) FROM ledger WHERE category IS NULL) AS uncategorized"))
def q_ingest_report(spark, sf_dir):
    return ingest.ingest_report(statements(spark, sf_dir))


_SCALED = "CASE WHEN row_seq % 5 = 0 THEN {0} || 'e11' ELSE {0} END"


@register("dropped_lines", O.PREFIX + f""", scaled AS (
  SELECT account_id, row_seq, narration AS description, {_SCALED.format("debit_text")} AS debit_text,
    {_SCALED.format("credit_text")} AS credit_text FROM statement),
wanted AS (
  SELECT *, CASE WHEN TRY_CAST(credit_text AS DOUBLE) > 0 THEN TRY_CAST(credit_text AS DOUBLE)
    WHEN TRY_CAST(debit_text AS DOUBLE) > 0 THEN TRY_CAST(debit_text AS DOUBLE) END AS amount FROM scaled)
SELECT account_id, row_seq, description, debit_text, credit_text,
  CASE WHEN amount IS NULL THEN '{ingest.NO_AMOUNT}' ELSE '{ingest.TOO_LARGE}' END AS reason
FROM wanted WHERE TRY_CAST(amount AS DECIMAL(18,2)) IS NULL""")
def q_dropped_lines(spark, sf_dir):
    """Every fifth amount is 10^11 times as large: those from 100,000 on do not fit."""
    st = statements(spark, sf_dir)
    scaled = st.withColumns({c: F.when(F.col("row_seq") % 5 == 0, F.concat(c, F.lit("e11"))).otherwise(F.col(c))
                             for c in ("debit_text", "credit_text")})
    return ingest.dropped_lines(scaled).drop("source_file")


# ---------------------------------------------------------------- IO6, P1-P3, P7, P8

ROW_SELECT = ("SELECT account_id, row_seq, date, description, " + O.dbl("amount") +
              " AS amount, transaction_type, category, is_saving, hash FROM ledger")


@register("ledger_page", O.over_ledger(
    ROW_SELECT + " ORDER BY date DESC, row_seq DESC, account_id DESC LIMIT 500 OFFSET 100"))
def q_ledger_page(spark, sf_dir):
    return rows.ledger_page(ledger_of(spark, sf_dir), limit=500, offset=100)


@register("month_slice", O.over_ledger(ROW_SELECT + f" WHERE month = '{AS_OF_MONTH}' ORDER BY date, row_seq"))
def q_month_slice(spark, sf_dir):
    return rows.month_slice(ledger_of(spark, sf_dir), AS_OF_MONTH)


@register("uncategorized", O.over_ledger(ROW_SELECT + " WHERE category IS NULL"))
def q_uncategorized(spark, sf_dir):
    return rows.uncategorized(ledger_of(spark, sf_dir))


@register("txn_search", O.over_ledger(
    ROW_SELECT + " WHERE transaction_type = 'Debit' AND coalesce(category, '') = '' "
    "AND contains(lower(description), 'merchant') AND starts_with(date, '1996')"))
def q_txn_search(spark, sf_dir):
    return rows.search(ledger_of(spark, sf_dir), transaction_type="Debit", category="_uncategorized",
                       text="Merchant", month="1996")


@register("txn_search_counts", O.over_ledger(
    "SELECT count_if(transaction_type = 'Credit' AND contains(lower(description), 'refund')) AS shown, "
    "count_if(coalesce(category, '') = '') AS uncategorized FROM ledger"))
def q_txn_search_counts(spark, sf_dir):
    return rows.search_counts(ledger_of(spark, sf_dir), transaction_type="Credit", text="REFUND")


@register("label_group", O.over_ledger(
    "SELECT account_id, row_seq, hash, CASE WHEN is_saving = 1 THEN 'Savings/Investment' "
    "WHEN transaction_type = 'Credit' THEN 'Income' ELSE 'Expense' END AS label_group FROM ledger"))
def q_label_group(spark, sf_dir):
    return rows.label_groups(ledger_of(spark, sf_dir))


def _taxonomy_values() -> str:
    from finledger.taxonomy import ordered_categories
    vals = ", ".join(f"({p}, {O._q(g)}, {O._q(c)}, {len(k)})" for p, g, c, k in ordered_categories())
    return f"dim(priority, label_group, category, n_keywords) AS (VALUES {vals})"


@register("taxonomy", O.over_ledger(
    "SELECT d.label_group, d.category, d.priority, d.n_keywords, CAST(coalesce(u.n, 0) AS BIGINT) AS n_rows "
    "FROM dim d LEFT JOIN (SELECT category, count(*) AS n FROM ledger WHERE category IS NOT NULL "
    "GROUP BY category) u ON d.category = u.category", _taxonomy_values()))
def q_taxonomy(spark, sf_dir):
    return rows.taxonomy_usage(ledger_of(spark, sf_dir))


# ---------------------------------------------------------------- A1-A4, A6, A18

def _summary_sql(by: str) -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return O.over_ledger(
        f"SELECT {sel}"
        "CAST(coalesce(sum(CASE WHEN transaction_type = 'Credit' THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_income, "
        "CAST(coalesce(sum(CASE WHEN transaction_type = 'Debit' THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_expenses, "
        "CAST(coalesce(sum(CASE WHEN is_saving = 1 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_savings, "
        "count(*) AS total_count, "
        "CAST(coalesce(sum(CASE WHEN transaction_type = 'Credit' THEN amount ELSE 0 END), 0) - "
        "coalesce(sum(CASE WHEN transaction_type = 'Debit' THEN amount ELSE 0 END), 0) AS DOUBLE) AS net_position, "
        f"count_if(coalesce(category, '') = '') AS uncategorized_count FROM ledger{grp}")


@register("summary", _summary_sql(""))
def q_summary(spark, sf_dir):
    return summary.summary(ledger_of(spark, sf_dir))


@register("summary_by_account", _summary_sql("account_id"))
def q_summary_by_account(spark, sf_dir):
    return summary.summary(ledger_of(spark, sf_dir), by=ACCT)


MONTHLY_SQL = (
    "monthly AS (SELECT {sel}month, "
    "sum(CASE WHEN transaction_type = 'Credit' THEN amount ELSE 0 END) AS income, "
    "sum(CASE WHEN transaction_type = 'Debit' AND is_saving = 0 THEN amount ELSE 0 END) AS expenses, "
    "sum(CASE WHEN is_saving = 1 THEN amount ELSE 0 END) AS savings FROM ledger GROUP BY {sel}month)")


@register("monthly_breakdown", O.over_ledger(
    "SELECT month, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses, "
    "CAST(savings AS DOUBLE) AS savings FROM monthly", MONTHLY_SQL.format(sel="")))
def q_monthly_breakdown(spark, sf_dir):
    return summary.monthly_breakdown(ledger_of(spark, sf_dir))


@register("category_breakdown", O.over_ledger(
    "SELECT category, CAST(sum(amount) AS DOUBLE) AS total FROM ledger WHERE transaction_type = 'Debit' "
    "GROUP BY category"))
def q_category_breakdown(spark, sf_dir):
    return summary.category_breakdown(ledger_of(spark, sf_dir), "Debit")


@register("category_breakdown_all", O.over_ledger(
    "SELECT category, CAST(sum(amount) AS DOUBLE) AS total FROM ledger GROUP BY category"))
def q_category_breakdown_all(spark, sf_dir):
    return summary.category_breakdown(ledger_of(spark, sf_dir))


@register("category_month", O.over_ledger(
    "SELECT month, category, CAST(sum(amount) AS DOUBLE) AS total FROM ledger "
    "WHERE transaction_type = 'Debit' AND category IS NOT NULL GROUP BY month, category"))
def q_category_month(spark, sf_dir):
    return summary.category_month(ledger_of(spark, sf_dir))


DAILY_SQL = (
    "daily AS (SELECT date, sum(amount) AS total FROM ledger WHERE transaction_type = 'Debit' "
    "GROUP BY date ORDER BY date DESC LIMIT {n})")


@register("daily_spending", O.over_ledger("SELECT date, CAST(total AS DOUBLE) AS total FROM daily",
                                          DAILY_SQL.format(n=93)))
def q_daily_spending(spark, sf_dir):
    return summary.daily_spending(ledger_of(spark, sf_dir), months_back=3)


@register("daily_spending_by_account", O.over_ledger(
    "SELECT account_id, date, total FROM (SELECT account_id, date, CAST(sum(amount) AS DOUBLE) AS total, "
    "row_number() OVER (PARTITION BY account_id ORDER BY date DESC) AS rk FROM ledger "
    "WHERE transaction_type = 'Debit' GROUP BY account_id, date) WHERE rk <= 93"))
def q_daily_spending_by_account(spark, sf_dir):
    return summary.daily_spending(ledger_of(spark, sf_dir), months_back=3, by=ACCT)


@register("spending_heatmap", O.over_ledger(
    "SELECT dayname(d) AS weekday, CAST((dayofweek(d) + 6) % 7 AS INT) AS weekday_no, CAST(weekofyear(d) AS INT) AS week, "
    "CAST(sum(total) AS DOUBLE) AS total FROM (SELECT TRY_CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS d, total FROM daily) WHERE d IS NOT NULL "
    "GROUP BY ALL", DAILY_SQL.format(n=186)))
def q_spending_heatmap(spark, sf_dir):
    return summary.spending_heatmap(ledger_of(spark, sf_dir), months_back=6)


@register("heatmap_matrix", O.over_ledger(
    "SELECT weekday_no, weekday, " + ", ".join(f"coalesce(CAST(sum(total) FILTER (week = {w}) AS DOUBLE), 0) AS week_{w}" for w in summary.ISO_WEEKS) +
    " FROM (SELECT dayname(d) AS weekday, CAST((dayofweek(d) + 6) % 7 AS INT) AS weekday_no, weekofyear(d) AS week, total "
    "FROM (SELECT TRY_CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS d, total FROM daily) WHERE d IS NOT NULL) GROUP BY weekday_no, weekday", DAILY_SQL.format(n=186)))
def q_heatmap_matrix(spark, sf_dir):
    """A4b as the chart shows it: weekdays by weeks of the year."""
    return summary.heatmap_matrix(summary.spending_heatmap(ledger_of(spark, sf_dir), months_back=6))


# ---------------------------------------------------------------- W1-W7, A5, A13, A16, A17

def _trends_sql(by: str, extra: str = "", of: str = "monthly") -> str:
    part = f"PARTITION BY {by} " if by else ""
    sel = f"{by}, " if by else ""
    w3 = f"OVER ({part}ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    w6 = f"OVER ({part}ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    return O.over_ledger(
        f"SELECT {sel}month, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses, "
        "CAST(savings AS DOUBLE) AS savings, "
        f"{O.r2(f'CAST(sum(expenses) {w3} AS DOUBLE) / CAST(count(*) {w3} AS DOUBLE)')} AS expense_ma3, "
        f"{O.r2(f'CAST(sum(expenses) {w6} AS DOUBLE) / CAST(count(*) {w6} AS DOUBLE)')} AS expense_ma6, "
        f"{O.r1('CASE WHEN CAST(income AS DOUBLE) > 0 THEN CAST(savings AS DOUBLE) / CAST(income AS DOUBLE) * 100 ELSE 0.0 END')} AS savings_rate "
        f"FROM {of}", MONTHLY_SQL.format(sel=sel) + (", " + extra if extra else ""))


@register("monthly_trends", _trends_sql(""))
def q_monthly_trends(spark, sf_dir):
    return trends.monthly_trends(ledger_of(spark, sf_dir))


@register("monthly_trends_by_account", _trends_sql("account_id"))
def q_monthly_trends_by_account(spark, sf_dir):
    return trends.monthly_trends(ledger_of(spark, sf_dir), by=ACCT)


def _anomalies_sql(factor: float, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    part = f"PARTITION BY {by}, category" if by else "PARTITION BY category"
    return O.over_ledger(
        f"SELECT {sel}month, category, {O.r2('t')} AS amount, {O.r2('avg')} AS average, "
        f"{O.r1('(t / avg - 1) * 100')} AS spike_pct FROM ("
        f"SELECT {sel}month, category, CAST(total AS DOUBLE) AS t, "
        f"CAST(sum(total) OVER ({part}) AS DOUBLE) / CAST(count(*) OVER ({part}) AS DOUBLE) AS avg FROM ("
        f"SELECT {sel}month, coalesce(nullif(category, ''), 'Uncategorized') AS category, sum(amount) AS total "
        f"FROM ledger WHERE transaction_type = 'Debit' GROUP BY {sel}month, category)) "
        f"WHERE avg > 0 AND t > avg * {factor}")


@register("anomalies", _anomalies_sql(1.5))
def q_anomalies(spark, sf_dir):
    return trends.anomalies(ledger_of(spark, sf_dir), 1.5)


@register("anomalies_by_account", _anomalies_sql(1.5, "account_id"))
def q_anomalies_by_account(spark, sf_dir):
    return trends.anomalies(ledger_of(spark, sf_dir), 1.5, by=ACCT)


def _growth_sql(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    part = f"PARTITION BY {by}, category" if by else "PARTITION BY category"
    inner = (
        f"SELECT {sel}category, total, row_number() OVER ({part} ORDER BY month) - 1 AS pos, "
        f"count(*) OVER ({part}) AS n FROM (SELECT {sel}category, month, sum(amount) AS total FROM ledger "
        f"WHERE transaction_type = 'Debit' AND category IS NOT NULL GROUP BY {sel}category, month)")
    halves = (
        f"SELECT {sel}category, sum(CASE WHEN pos < n // 2 THEN total ELSE 0 END) AS f, "
        f"sum(CASE WHEN pos < n // 2 THEN 0 ELSE total END) AS s, max(n) AS n FROM ({inner}) "
        f"WHERE n >= 2 GROUP BY {sel}category")
    growth = ("CASE WHEN f > 0 THEN CAST(s - f AS DOUBLE) / CAST(f AS DOUBLE) * 100 "
              "WHEN s > 0 THEN 100.0 ELSE 0.0 END")
    return O.over_ledger(
        f"SELECT {sel}category, {O.r1(growth)} AS growth_pct, "
        f"{O.r2('CAST(s AS DOUBLE) / CAST(n - n // 2 AS DOUBLE)')} AS recent_avg FROM ({halves})")


@register("growth_rates", _growth_sql())
def q_growth_rates(spark, sf_dir):
    return trends.growth_rates(ledger_of(spark, sf_dir))


@register("growth_rates_by_account", _growth_sql("account_id"))
def q_growth_rates_by_account(spark, sf_dir):
    return trends.growth_rates(ledger_of(spark, sf_dir), by=ACCT)


@register("seasonal", O.over_ledger(
    "SELECT cal_month, CASE WHEN cal_month > 12 THEN 'Unknown' WHEN cal_month >= 0 THEN "
    f"{O.month_names_sql()}[cal_month + 1] ELSE {O.month_names_sql()}[cal_month + 14] END AS month_name, "
    f"{O.r2('CAST(total AS DOUBLE) / CAST(txn_count AS DOUBLE)')} AS avg_daily_spend, "
    "CAST(total AS DOUBLE) AS total_spend, txn_count, "
    f"{O.r1('(CAST(total AS DOUBLE) / (CAST(sum(total) OVER () AS DOUBLE) / CAST(count(*) OVER () AS DOUBLE)) - 1) * 100')} "
    "AS vs_average_pct FROM (SELECT " + O.cal_month("date") + " AS cal_month, "
    "sum(amount) AS total, count(*) AS txn_count FROM ledger WHERE transaction_type = 'Debit' GROUP BY 1)"))
def q_seasonal(spark, sf_dir):
    return trends.seasonal_patterns(ledger_of(spark, sf_dir))


def _forecast_sql(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    pts = (
        f"SELECT {sel}CAST(row_number() OVER ({part}ORDER BY month) - 1 AS BIGINT) AS x, income, expenses FROM ("
        f"SELECT {sel}month, sum(CASE WHEN transaction_type = 'Credit' THEN amount ELSE 0 END) AS income, "
        f"sum(CASE WHEN transaction_type = 'Debit' THEN amount ELSE 0 END) AS expenses FROM ledger GROUP BY {sel}month)")
    sums = (
        f"SELECT {sel}count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(income) AS sy_i, sum(income * x) AS sxy_i, "
        f"sum(expenses) AS sy_e, sum(expenses * x) AS sxy_e FROM ({pts}){grp}")

    def line(sy, sxy):
        num = f"(n * {sxy} - sx * {sy})"
        pred = f"({num} * n + ({sy} * sxx - sx * {sxy}))"
        den = "CAST(n * sxx - sx * sx AS DOUBLE)"
        return num, f"CAST({num} AS DOUBLE) / {den}", f"CAST({pred} AS DOUBLE) / {den}"

    e_num, e_slope, e_pred = line("sy_e", "sxy_e")
    i_num, i_slope, i_pred = line("sy_i", "sxy_i")
    return O.over_ledger(
        f"SELECT {sel}{O.r2(f'greatest(0.0, {e_pred})')} AS forecast_expenses, "
        f"{O.r2(f'greatest(0.0, {i_pred})')} AS forecast_income, "
        f"CASE WHEN {e_num} > 0 THEN 'increasing' ELSE 'decreasing' END AS expense_trend, "
        f"CASE WHEN {i_num} > 0 THEN 'increasing' ELSE 'decreasing' END AS income_trend, "
        f"{O.r2(e_slope)} AS expense_change_per_month, {O.r2(i_slope)} AS income_change_per_month, "
        f"n AS months_analyzed FROM ({sums}) WHERE n >= 2")


@register("forecast", _forecast_sql())
def q_forecast(spark, sf_dir):
    return trends.forecast(ledger_of(spark, sf_dir))


@register("forecast_by_account", _forecast_sql("account_id"))
def q_forecast_by_account(spark, sf_dir):
    return trends.forecast(ledger_of(spark, sf_dir), by=ACCT)


# Register the remaining query groups (they import the helpers above).
from finledger.plans import more_queries as _more  # noqa: E402,F401
from finledger.plans import ml_stream_queries as _ml_stream  # noqa: E402,F401
