"""Registered queries: budgets, habits, suggestions, festivals, corrections.

Small dimensions (budget log, scenarios, festivals, corrections) are derived
from the ledger itself or are fixed user inputs of a few rows; the work of
every query still grows with the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finledger.operators import budget, corrections, festivals, habits, ingest, ledger as rows, summary, trends
from finledger.operators._common import top_rows, with_position
from finledger.operators.ingest import training_rows
from finledger.plans import oracle as O
from finledger.plans.catalog import ACCT, AS_OF_MONTH, ledger_of, register, statements
from finledger.plans.catalog import _anomalies_sql as catalog_anomalies_sql
from finledger.plans.catalog import _growth_sql as catalog_growth_sql
from finledger.plans.catalog import _trends_sql as catalog_trends_sql
from finledger.plans.fixtures import AS_OF, CORRECTION_RULES, DAYS_AHEAD, SCENARIOS, budget_log_from_history, festival_events
from finledger.session import prepare_session
from finledger.sources.derived import read_table
from finledger.taxonomy import (
    CATEGORY_TIPS, CURRENCY_SYMBOL, DEFAULT_FESTIVALS, DEFAULT_TIP, FESTIVAL_MESSAGES, SUGGESTION_MESSAGES,
)

# ---------------------------------------------------------------- budgets


def _budget_log_sql(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    start = "TRY_CAST(month || '-01' AS DATE)"
    return (
        f"log AS (SELECT {sel}category, CAST(sum(amount) AS DECIMAL(18,2)) AS monthly_limit, "
        f"CAST({start} AS TIMESTAMP) AS event_time, 'set' AS op FROM ledger WHERE transaction_type = 'Debit' "
        f"AND category IS NOT NULL AND {start} IS NOT NULL GROUP BY {sel}category, month "
        f"UNION ALL SELECT {sel}category, NULL, min(CAST({start} AS TIMESTAMP)) + INTERVAL 1 DAY, 'delete' "
        f"FROM ledger WHERE transaction_type = 'Debit' AND category IS NOT NULL AND {start} IS NOT NULL "
        f"GROUP BY {sel}category), "
        f"live AS (SELECT * FROM (SELECT *, max(CASE WHEN op = 'delete' THEN event_time END) OVER "
        f"(PARTITION BY {sel}category) AS last_delete FROM log) WHERE last_delete IS NULL OR event_time > last_delete), "
        f"cur AS (SELECT {sel}category, arg_max(monthly_limit, event_time) AS monthly_limit, "
        f"arg_max(op, event_time) AS op, min(CASE WHEN op = 'set' THEN event_time END) AS created_at, "
        f"max(event_time) AS updated_at FROM live GROUP BY {sel}category), "
        f"budgets AS (SELECT * FROM cur WHERE op = 'set')"
    )


def _current(ledger, by=()):
    return budget.current_budgets(budget_log_from_history(ledger, by), by)


@register("budgets_current", O.over_ledger(
    "SELECT category, CAST(monthly_limit AS DOUBLE) AS monthly_limit, "
    "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at "
    "FROM budgets", _budget_log_sql()))
def q_budgets_current(spark, sf_dir):
    cur = _current(ledger_of(spark, sf_dir))
    return cur.select(
        "category", F.col("monthly_limit").cast("double").alias("monthly_limit"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    ).orderBy("category")


def _bva_sql(by: str = "", top: int | None = None) -> str:
    sel = f"{by}, " if by else ""
    on = f"b.{by} = s.{by} AND " if by else ""
    util = ("CASE WHEN monthly_limit > 0 THEN CAST(spent AS DOUBLE) / CAST(monthly_limit AS DOUBLE) * 100 "
            "ELSE 0.0 END")
    inner = (
        f"SELECT {', '.join('b.' + c for c in ([by] if by else []) + ['category'])}, b.monthly_limit, "
        f"coalesce(s.spent, 0) AS spent FROM budgets b LEFT JOIN (SELECT {sel}category, sum(amount) AS spent "
        f"FROM ledger WHERE transaction_type = 'Debit' AND month = '{AS_OF_MONTH}' GROUP BY {sel}category) s "
        f"ON {on}b.category = s.category")
    body = (
        f"SELECT {sel}category, '{AS_OF_MONTH}' AS month, CAST(monthly_limit AS DOUBLE) AS budget, "
        f"CAST(spent AS DOUBLE) AS spent, CAST(monthly_limit - spent AS DOUBLE) AS remaining, "
        f"{O.r1(util)} AS utilization_pct, CASE WHEN spent > monthly_limit THEN 'over' "
        f"WHEN spent > monthly_limit * 0.8 THEN 'warning' ELSE 'ok' END AS status FROM ({inner})")
    if top is None:
        return body
    return (f"SELECT *, least(utilization_pct, 100.0) AS bar_pct FROM ({body}) "
            f"ORDER BY utilization_pct DESC, category LIMIT {top}")


@register("budget_vs_actual", O.over_ledger(_bva_sql(), _budget_log_sql()))
def q_budget_vs_actual(spark, sf_dir):
    led = ledger_of(spark, sf_dir)
    return budget.budget_vs_actual(led, _current(led), AS_OF_MONTH)


@register("budget_vs_actual_by_account", O.over_ledger(_bva_sql("account_id"), _budget_log_sql("account_id")))
def q_budget_vs_actual_by_account(spark, sf_dir):
    led = ledger_of(spark, sf_dir)
    return budget.budget_vs_actual(led, _current(led, ACCT), AS_OF_MONTH, by=ACCT)


@register("budget_status_top", O.over_ledger(_bva_sql(top=5), _budget_log_sql()))
def q_budget_status_top(spark, sf_dir):
    led = ledger_of(spark, sf_dir)
    return budget.budget_status_top(budget.budget_vs_actual(led, _current(led), AS_OF_MONTH), 5)


def _ratio_sql(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    nsd = "transaction_type = 'Debit' AND is_saving = 0"
    pct = lambda x: O.r1(f"CAST({x} AS DOUBLE) / CAST(income AS DOUBLE) * 100")
    return O.over_ledger(
        f"SELECT {sel}CAST(income AS DOUBLE) AS income, CAST(needs AS DOUBLE) AS needs, "
        f"CAST(expenses - needs AS DOUBLE) AS wants, CAST(savings AS DOUBLE) AS savings, "
        f"{pct('needs')} AS needs_pct, {pct('expenses - needs')} AS wants_pct, {pct('savings')} AS savings_pct, "
        "50 AS ideal_needs_pct, 30 AS ideal_wants_pct, 20 AS ideal_savings_pct FROM ("
        f"SELECT {sel}sum(CASE WHEN transaction_type = 'Credit' THEN amount ELSE 0 END) AS income, "
        f"sum(CASE WHEN {nsd} THEN amount ELSE 0 END) AS expenses, "
        "sum(CASE WHEN is_saving = 1 THEN amount ELSE 0 END) AS savings, "
        f"sum(CASE WHEN {nsd} AND category IN {O.NEEDS_IN} THEN amount ELSE 0 END) AS needs "
        f"FROM ledger{grp}) WHERE income > 0")


@register("spending_ratio", _ratio_sql())
def q_spending_ratio(spark, sf_dir):
    return budget.spending_ratio(ledger_of(spark, sf_dir))


@register("spending_ratio_by_account", _ratio_sql("account_id"))
def q_spending_ratio_by_account(spark, sf_dir):
    return budget.spending_ratio(ledger_of(spark, sf_dir), by=ACCT)


@register("rule_allocation", O.over_ledger(
    "SELECT month, CAST(income AS DOUBLE) AS income, "
    f"{O.r2('CAST(income * 0.5 AS DOUBLE)')} AS needs, {O.r2('CAST(income * 0.3 AS DOUBLE)')} AS wants, "
    f"{O.r2('CAST(income * 0.2 AS DOUBLE)')} AS savings FROM (SELECT month, "
    "sum(CASE WHEN transaction_type = 'Credit' THEN amount ELSE 0 END) AS income FROM ledger GROUP BY month)"))
def q_rule_allocation(spark, sf_dir):
    return budget.rule_allocation(ledger_of(spark, sf_dir))


# ---------------------------------------------------------------- habits

def _disc_sql(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    return (
        f"SELECT {sel}category, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS txn_count, "
        "CAST(sum(amount) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_amount FROM ledger "
        f"WHERE transaction_type = 'Debit' AND category IN {O.DISCRETIONARY_IN} GROUP BY {sel}category")


@register("discretionary", O.over_ledger(_disc_sql()))
def q_discretionary(spark, sf_dir):
    return habits.discretionary(ledger_of(spark, sf_dir))


@register("discretionary_by_account", O.over_ledger(_disc_sql("account_id")))
def q_discretionary_by_account(spark, sf_dir):
    return habits.discretionary(ledger_of(spark, sf_dir), by=ACCT)


def _subs_sql(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    avg = "CAST(sum(amount) AS DOUBLE) / CAST(count(*) AS DOUBLE)"
    return (
        f"SELECT {sel}description, count(*) AS occurrences, CAST(sum(amount) AS DOUBLE) AS total_spent, "
        f"{avg} AS avg_amount, min(date) AS first_seen, max(date) AS last_seen, {O.r2(avg + ' * 12')} AS estimated_annual "
        "FROM ledger WHERE transaction_type = 'Debit' AND (category = 'Subscriptions' "
        "OR description ILIKE '%SUBSCRIPTION%' OR description ILIKE '%RECURRING%') "
        f"GROUP BY {sel}description HAVING count(*) >= 2")


@register("subscription_audit", O.over_ledger(_subs_sql()))
def q_subscription_audit(spark, sf_dir):
    return habits.subscription_audit(ledger_of(spark, sf_dir))


@register("subscription_audit_by_account", O.over_ledger(_subs_sql("account_id")))
def q_subscription_audit_by_account(spark, sf_dir):
    return habits.subscription_audit(ledger_of(spark, sf_dir), by=ACCT)




def _what_if_sql() -> str:
    vals = ", ".join(f"({O._q(c)}, CAST({p} AS DOUBLE))" for c, p in SCENARIOS)
    avg = "CAST(total AS DOUBLE) / CAST(months AS DOUBLE)"
    saving = f"({avg} * (reduction_pct / 100))"
    return O.over_ledger(
        f"SELECT m.category, {O.r2(avg)} AS current_monthly_avg, reduction_pct, {O.r2(saving)} AS monthly_saving, "
        f"{O.r2(saving + ' * 12')} AS annual_saving, {O.r2(avg + ' - ' + saving)} AS new_monthly_avg "
        "FROM (SELECT category, sum(m) AS total, count(*) AS months FROM (SELECT category, month, sum(amount) AS m "
        "FROM ledger WHERE transaction_type = 'Debit' GROUP BY category, month) GROUP BY category "
        "HAVING sum(m) <> 0) m JOIN sc ON m.category = sc.category",
        f"sc(category, reduction_pct) AS (VALUES {vals})")


@register("what_if", _what_if_sql())
def q_what_if(spark, sf_dir):
    led = ledger_of(spark, sf_dir)
    return habits.what_if(led, habits.scenarios(spark, SCENARIOS))


# ---------------------------------------------------------------- suggestions

def _fmt0(x: str) -> str:
    return f"format('{{:,.0f}}', CAST({x} AS DOUBLE))"


def _suggestions_sql(ordered: bool = False) -> str:
    tips = ", ".join(f"({O._q(c)}, {O._q(t)})" for c, t in sorted(CATEGORY_TIPS.items()))
    bva, msg = _bva_sql(), SUGGESTION_MESSAGES
    excess = O.r2("spent - budget")
    budget_rows = (
        "SELECT CASE WHEN status = 'over' THEN 'high' ELSE 'medium' END AS priority, category, "
        "CASE WHEN status = 'over' THEN 'budget_overrun' ELSE 'budget_warning' END AS type, "
        f"CASE WHEN status = 'over' THEN {O.filled(msg['budget_overrun'], category='category', excess=_fmt0(excess), used='utilization_pct')} "
        f"ELSE {O.filled(msg['budget_warning'], category='category', used='utilization_pct', remaining=_fmt0('remaining'))} END AS message, "
        f"CASE WHEN status = 'over' THEN {excess} END AS potential_saving, 1 AS rule_no, utilization_pct AS seq "
        f"FROM ({bva}) WHERE status IN ('over', 'warning')")
    disc = (
        "SELECT 'medium' AS priority, d.category, 'discretionary_spending' AS type, "
        f"{O.filled(msg['discretionary_spending'], category='d.category', total=_fmt0('d.total'), tip=f'coalesce(t.tip, {O._q(DEFAULT_TIP)})')} AS message, "
        "CAST(NULL AS DOUBLE) AS potential_saving, 2 AS rule_no, d.total AS seq "
        f"FROM (SELECT * FROM ({_disc_sql()}) ORDER BY total DESC, category LIMIT 3) d "
        "LEFT JOIN tips t ON d.category = t.category")
    subs = (
        "SELECT 'medium' AS priority, 'Subscriptions' AS category, 'subscription_audit' AS type, "
        f"{O.filled(msg['subscription_audit'], count='n', annual=_fmt0('total_annual'))} AS message, "
        f"{O.r2('CAST(total_annual AS DOUBLE) * 0.2')} AS potential_saving, 3 AS rule_no, 0 AS seq FROM ("
        f"SELECT count(*) AS n, sum(CAST(estimated_annual AS DECIMAL(18,2))) AS total_annual FROM ({_subs_sql()})) "
        "WHERE n > 0")
    ratio_inner = _ratio_sql()[len(O.PREFIX):]
    ratio = (
        "SELECT 'high' AS priority, 'Overall' AS category, 'spending_ratio' AS type, "
        f"{O.filled(msg['spending_ratio'], wants='wants_pct')} AS message, "
        f"CAST(NULL AS DOUBLE) AS potential_saving, 4 AS rule_no, 0 AS seq FROM ({ratio_inner}) WHERE wants_pct > 35 "
        f"UNION ALL SELECT 'high', 'Overall', 'savings_low', {O.filled(msg['savings_low'], savings='savings_pct')}, CAST(NULL AS DOUBLE), 5, 0 "
        f"FROM ({ratio_inner}) WHERE savings_pct < 15")
    rank = "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
    place = f", row_number() OVER (ORDER BY {rank}, rule_no, seq DESC, category) AS position"
    titles = " ".join(f"WHEN '{t}' THEN '{t.replace('_', ' ').title()}'" for t in SUGGESTION_MESSAGES)
    more = f"{place}, CASE type {titles} END AS type_label" if ordered else ""
    return O.over_ledger(
        "SELECT priority, category, type, message, potential_saving, "
        f"{rank} AS priority_rank, rule_no{more} FROM ("
        f"{budget_rows} UNION ALL {disc} UNION ALL {subs} UNION ALL {ratio})",
        _budget_log_sql() + f", tips(category, tip) AS (VALUES {tips})")


@register("suggestions", _suggestions_sql())
def q_suggestions(spark, sf_dir):
    led = ledger_of(spark, sf_dir)
    return habits.suggestions(led, _current(led), AS_OF_MONTH)


@register("suggestions_ordered", _suggestions_sql(ordered=True))
def q_suggestions_ordered(spark, sf_dir):
    """The suggestions with their place in the list and the type as it is shown."""
    led = ledger_of(spark, sf_dir)
    return habits.suggestions(led, _current(led), AS_OF_MONTH, positions=True).withColumn("type_label", habits.type_label())


@register("subscription_audit_ordered", O.over_ledger(
    f"SELECT *, row_number() OVER (ORDER BY total_spent DESC, description) AS position FROM ({_subs_sql()})"))
def q_subscription_audit_ordered(spark, sf_dir):
    """The audit with the place of each row."""
    return with_position(habits.subscription_audit(ledger_of(spark, sf_dir)), [F.col("total_spent").desc(), F.col("description")])


# ---------------------------------------------------------------- festivals (A14, A15, R2-R4, M3, IO10)


@register("festivals_current", """
WITH e AS (SELECT 'Festival ' || CAST(o_custkey % 400 AS VARCHAR) AS name, CAST(o_custkey % 12 + 1 AS INT) AS month, CAST(o_custkey % 28 + 1 AS INT) AS day,
    CAST(o_orderkey % 5 + 1 AS INT) AS duration_days, o_orderdate AS t, o_orderkey AS k,
    CASE WHEN o_orderkey % 7 = 0 THEN 'remove' WHEN o_orderkey % 7 < 3 THEN 'add' ELSE 'seed' END AS op FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY name, month, day ORDER BY op <> 'seed' DESC,
    CASE WHEN op <> 'seed' THEN t END DESC NULLS LAST, CASE WHEN op <> 'seed' THEN k END DESC NULLS LAST, t, k) AS n FROM e)
SELECT name, month, day, duration_days, row_number() OVER (ORDER BY month, day, name) AS position FROM r WHERE n = 1 AND op <> 'remove'
""")
def q_festivals_current(spark, sf_dir):
    """IO10, M3: the active festivals of a change log, in display order."""
    prepare_session(spark)
    return festivals.current_festivals(festival_events(read_table(spark, sf_dir, "orders")))



def _fest_values() -> str:
    vals = ", ".join(f"(CAST({i + 1} AS BIGINT), {O._q(n)}, {m}, {d}, {dur}, 1)"
                     for i, (n, m, d, dur) in enumerate(DEFAULT_FESTIVALS))
    return f"fest(festival_id, name, month, day, duration_days, is_active) AS (VALUES {vals})"


_MONTHLY_DEBIT = ("md AS (SELECT month, " + O.cal_month("month") + " AS cal_month, "
                  "sum(amount) AS total FROM ledger WHERE transaction_type = 'Debit' GROUP BY month)")


def _history_sql() -> str:
    fa = "coalesce(CAST(c.s AS DOUBLE) / CAST(c.n AS DOUBLE), 0.0)"
    oa = "coalesce(CAST(o.s AS DOUBLE) / CAST(o.n AS DOUBLE), 0.0)"
    extra = f"greatest(0.0, {fa} - {oa})"
    return (
        f"hist AS (SELECT f.festival_id, f.name, f.month, f.day, f.duration_days, {O.r2(fa)} AS avg_spend, "
        f"{O.r2(oa)} AS normal_avg, {O.r2(extra)} AS extra_spend, {O.r2(extra + ' * 1.1')} AS suggested_saving "
        "FROM fest f LEFT JOIN (SELECT cal_month, sum(total) AS s, count(*) AS n FROM md GROUP BY cal_month) c "
        "ON f.month = c.cal_month, (SELECT sum(total) AS s, count(*) AS n FROM md) o WHERE f.is_active = 1)")


@register("festival_history", O.over_ledger("SELECT * FROM hist",
                                            _fest_values() + ", " + _MONTHLY_DEBIT + ", " + _history_sql()))
def q_festival_history(spark, sf_dir):
    return festivals.festival_history(ledger_of(spark, sf_dir), festivals.festivals_table(spark))


def _upcoming_sql(mode: str) -> str:
    y = AS_OF.year
    today = f"DATE '{AS_OF.date().isoformat()}'"
    ts = f"TIMESTAMP '{AS_OF.strftime('%Y-%m-%d %H:%M:%S')}'"
    mk = lambda yy: f"TRY_CAST(printf('%04d-%02d-%02d', {yy}, month, day) AS DATE)"
    this, nxt_y = mk(y), mk(y + 1)
    if mode == "date":
        nxt = f"CASE WHEN {this} < {today} THEN {nxt_y} ELSE {this} END"
        days = f"CAST(datediff('day', {today}, nd) AS INT)"
    else:
        nxt = f"CASE WHEN CAST({this} AS TIMESTAMP) < {ts} THEN {nxt_y} ELSE {this} END"
        days = f"CAST(floor((epoch(CAST(nd AS TIMESTAMP)) - epoch({ts})) / 86400) AS INT)"
    m, sym = FESTIVAL_MESSAGES, O._q(CURRENCY_SYMBOL)
    msg = (
        f"CASE WHEN days_until = 0 THEN {O.filled(m['today'], name='name')} WHEN days_until = 1 THEN {O.filled(m['tomorrow'], name='name')} "
        f"ELSE {O.filled(m['later'], name='name', days='days_until')} END || "
        f"CASE WHEN avg_spend > 0 THEN {O.filled(m['history'], symbol=sym, average=_fmt0('avg_spend'))} || "
        f"CASE WHEN extra_spend > 0 THEN {O.filled(m['extra'], symbol=sym, extra=_fmt0('extra_spend'), suggested=_fmt0('suggested_saving'))} "
        f"ELSE '.' END ELSE {O._q(m['no_history'])} END")
    return O.over_ledger(
        "SELECT festival_id, name, strftime(nd, '%Y-%m-%d') AS date, days_until, duration_days, "
        f"avg_spend AS historical_avg_spend, suggested_saving, {msg} AS message, "
        "CASE WHEN days_until <= 7 THEN 'danger' WHEN days_until <= 14 THEN 'warning' ELSE 'info' END AS urgency, "
        "CASE WHEN days_until <= 7 THEN 'danger' ELSE 'warning' END AS banner FROM ("
        f"SELECT *, {days} AS days_until FROM (SELECT *, {nxt} AS nd FROM hist WHERE {this} IS NOT NULL)) "
        f"WHERE nd IS NOT NULL AND days_until BETWEEN 0 AND {DAYS_AHEAD}",
        _fest_values() + ", " + _MONTHLY_DEBIT + ", " + _history_sql())


@register("upcoming_festivals", _upcoming_sql("date"))
def q_upcoming_festivals(spark, sf_dir):
    return festivals.upcoming_festivals(ledger_of(spark, sf_dir), festivals.festivals_table(spark), AS_OF,
                                        days_ahead=DAYS_AHEAD, mode="date")


@register("upcoming_festivals_reference_mode", _upcoming_sql("reference"))
def q_upcoming_festivals_ref(spark, sf_dir):
    return festivals.upcoming_festivals(ledger_of(spark, sf_dir), festivals.festivals_table(spark), AS_OF,
                                        days_ahead=DAYS_AHEAD, mode="reference")


def _festive_sql() -> str:
    months = sorted({m for _, m, _, _ in DEFAULT_FESTIVALS})
    fest = f"cal_month IN ({', '.join(str(m) for m in months)})"
    fa = "CASE WHEN f_n > 0 THEN CAST(f_sum AS DOUBLE) / CAST(f_n AS DOUBLE) ELSE 0.0 END"
    na = "CASE WHEN n_n > 0 THEN CAST(n_sum AS DOUBLE) / CAST(n_n AS DOUBLE) ELSE 0.0 END"
    diff = O.r2(f"({fa}) - ({na})")
    return O.over_ledger(
        f"SELECT {O.r2(fa)} AS festive_months_avg, {O.r2(na)} AS normal_months_avg, {diff} AS difference, "
        f"{O.r1(f'CASE WHEN ({na}) > 0 THEN (({fa}) - ({na})) / ({na}) * 100 ELSE 0.0 END')} AS difference_pct, "
        f"f_n AS festive_months_count, n_n AS normal_months_count, {O.r2(diff + ' / 12')} AS monthly_set_aside FROM ("
        f"SELECT sum(CASE WHEN {fest} THEN total ELSE 0 END) AS f_sum, count_if({fest}) AS f_n, "
        f"sum(CASE WHEN NOT ({fest}) THEN total ELSE 0 END) AS n_sum, count_if(NOT ({fest})) AS n_n FROM md) "
        "WHERE f_n + n_n > 0", _MONTHLY_DEBIT)


@register("festive_vs_normal", _festive_sql())
def q_festive_vs_normal(spark, sf_dir):
    return festivals.festive_vs_normal(ledger_of(spark, sf_dir), festivals.festivals_table(spark))


# ---------------------------------------------------------------- corrections (C6, J7, M4, IO4)



def _corrections_sql() -> str:
    case_cat = " ".join(f"WHEN processed = {O._q(t)} THEN {O._q(c)}" for t, (c, _) in CORRECTION_RULES.items())
    case_sav = " ".join(f"WHEN processed = {O._q(t)} THEN {s}" for t, (_, s) in CORRECTION_RULES.items())
    texts = O._in_list(CORRECTION_RULES)
    return (f"corr AS (SELECT account_id, hash, CASE {case_cat} END AS new_category, CASE {case_sav} END AS new_is_saving "
            f"FROM ledger WHERE category IS NULL AND processed IN {texts})")


def _corrected(spark, sf_dir):
    led = ledger_of(spark, sf_dir)
    corr = corrections.rule_corrections(led, CORRECTION_RULES)
    return led, corr


@register("corrections_applied", O.over_ledger(
    "SELECT l.account_id, l.row_seq, l.hash, coalesce(c.new_category, l.category) AS category, "
    "coalesce(c.new_is_saving, l.is_saving) AS is_saving FROM ledger l LEFT JOIN corr c "
    "ON l.account_id = c.account_id AND l.hash = c.hash", _corrections_sql()))
def q_corrections_applied(spark, sf_dir):
    led, corr = _corrected(spark, sf_dir)
    return corrections.apply_corrections(led, corr).select("account_id", "row_seq", "hash", "category", "is_saving")


@register("training_bag", O.over_ledger(
    "SELECT description, category, CAST(count(*) AS DOUBLE) AS weight FROM ("
    "SELECT processed AS description, category FROM ledger WHERE category IS NOT NULL UNION ALL "
    "SELECT l.processed, c.new_category FROM corr c JOIN ledger l ON l.account_id = c.account_id AND l.hash = c.hash) "
    "GROUP BY description, category", _corrections_sql()))
def q_training_bag(spark, sf_dir):
    led, corr = _corrected(spark, sf_dir)
    return corrections.weighted_bag(corrections.training_bag(led, corr))


@register("training_rows_count", O.over_ledger(
    "SELECT category, count(*) AS n FROM ledger WHERE category IS NOT NULL GROUP BY category"))
def q_training_rows_count(spark, sf_dir):
    return training_rows(ledger_of(spark, sf_dir)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- O4-O6: what the pages show


def _limit_sql(sql: str, order: str, k: int) -> str:
    head, select = sql.rsplit("\n", 1)
    return f"{head}\nSELECT * FROM ({select}) ORDER BY {order} LIMIT {k}"


@register("growth_top10", _limit_sql(catalog_growth_sql(), "growth_pct DESC, category", 10))
def q_growth_top10(spark, sf_dir):
    g = trends.growth_rates(ledger_of(spark, sf_dir))
    return top_rows(g, 10, [F.col("growth_pct").desc(), F.col("category")])


@register("anomalies_first10", _limit_sql(catalog_anomalies_sql(1.5), "month, category", 10))
def q_anomalies_first10(spark, sf_dir):
    return top_rows(trends.anomalies(ledger_of(spark, sf_dir), 1.5), 10, [F.col("month"), F.col("category")])


@register("upcoming_top3", _limit_sql(_upcoming_sql("date"), "days_until, festival_id", 3))
def q_upcoming_top3(spark, sf_dir):
    up = festivals.upcoming_festivals(ledger_of(spark, sf_dir), festivals.festivals_table(spark), AS_OF,
                                      days_ahead=DAYS_AHEAD)
    return top_rows(up, 3, [F.col("days_until"), F.col("festival_id")])


@register("uncategorized_first50", O.over_ledger(
    "SELECT account_id, row_seq, date, description, CAST(amount AS DOUBLE) AS amount, transaction_type, category, "
    "is_saving, hash FROM ledger WHERE category IS NULL ORDER BY date DESC, row_seq DESC, account_id DESC LIMIT 50"))
def q_uncategorized_first50(spark, sf_dir):
    unc = rows.uncategorized(ledger_of(spark, sf_dir))
    return top_rows(unc, 50, [F.col("date").desc(), F.col("row_seq").desc(), F.col("account_id").desc()])


# ---------------------------------------------------------------- per-account variants


_MONTHLY_DEBIT_ACCT = ("md AS (SELECT account_id, month, " + O.cal_month("month") + " "
                       "AS cal_month, sum(amount) AS total FROM ledger WHERE transaction_type = 'Debit' "
                       "GROUP BY account_id, month)")


def _history_acct_sql() -> str:
    fa = "coalesce(CAST(c.s AS DOUBLE) / CAST(c.n AS DOUBLE), 0.0)"
    oa = "coalesce(CAST(o.s AS DOUBLE) / CAST(o.n AS DOUBLE), 0.0)"
    extra = f"greatest(0.0, {fa} - {oa})"
    return (
        f"SELECT o.account_id, f.festival_id, f.name, f.month, f.day, f.duration_days, {O.r2(fa)} AS avg_spend, "
        f"{O.r2(oa)} AS normal_avg, {O.r2(extra)} AS extra_spend, {O.r2(extra + ' * 1.1')} AS suggested_saving "
        "FROM (SELECT a.account_id, sum(total) AS s, count(total) AS n FROM (SELECT DISTINCT account_id FROM ledger) a "
        "LEFT JOIN md USING (account_id) GROUP BY a.account_id) o "
        "JOIN fest f ON f.is_active = 1 "
        "LEFT JOIN (SELECT account_id, cal_month, sum(total) AS s, count(*) AS n FROM md GROUP BY account_id, cal_month) c "
        "ON c.account_id = o.account_id AND c.cal_month = f.month")


@register("festival_history_by_account", O.over_ledger(_history_acct_sql(), _fest_values() + ", " + _MONTHLY_DEBIT_ACCT))
def q_festival_history_by_account(spark, sf_dir):
    return festivals.festival_history(ledger_of(spark, sf_dir), festivals.festivals_table(spark), by=ACCT)


def _festive_acct_sql() -> str:
    months = sorted({m for _, m, _, _ in DEFAULT_FESTIVALS})
    fest = f"cal_month IN ({', '.join(str(m) for m in months)})"
    fa = "CASE WHEN f_n > 0 THEN CAST(f_sum AS DOUBLE) / CAST(f_n AS DOUBLE) ELSE 0.0 END"
    na = "CASE WHEN n_n > 0 THEN CAST(n_sum AS DOUBLE) / CAST(n_n AS DOUBLE) ELSE 0.0 END"
    diff = O.r2(f"({fa}) - ({na})")
    return O.over_ledger(
        f"SELECT account_id, {O.r2(fa)} AS festive_months_avg, {O.r2(na)} AS normal_months_avg, {diff} AS difference, "
        f"{O.r1(f'CASE WHEN ({na}) > 0 THEN (({fa}) - ({na})) / ({na}) * 100 ELSE 0.0 END')} AS difference_pct, "
        f"f_n AS festive_months_count, n_n AS normal_months_count, {O.r2(diff + ' / 12')} AS monthly_set_aside FROM ("
        f"SELECT account_id, sum(CASE WHEN {fest} THEN total ELSE 0 END) AS f_sum, count_if({fest}) AS f_n, "
        f"sum(CASE WHEN NOT ({fest}) THEN total ELSE 0 END) AS n_sum, count_if(NOT ({fest})) AS n_n FROM md "
        "GROUP BY account_id) WHERE f_n + n_n > 0", _MONTHLY_DEBIT_ACCT)


@register("festive_vs_normal_by_account", _festive_acct_sql())
def q_festive_vs_normal_by_account(spark, sf_dir):
    return festivals.festive_vs_normal(ledger_of(spark, sf_dir), festivals.festivals_table(spark), by=ACCT)


@register("seasonal_by_account", O.over_ledger(
    "SELECT account_id, cal_month, CASE WHEN cal_month > 12 THEN 'Unknown' WHEN cal_month >= 0 THEN "
    f"{O.month_names_sql()}[cal_month + 1] ELSE {O.month_names_sql()}[cal_month + 14] END AS month_name, "
    f"{O.r2('CAST(total AS DOUBLE) / CAST(txn_count AS DOUBLE)')} AS avg_daily_spend, "
    "CAST(total AS DOUBLE) AS total_spend, txn_count, "
    f"{O.r1('(CAST(total AS DOUBLE) / (CAST(sum(total) OVER (PARTITION BY account_id) AS DOUBLE) / CAST(count(*) OVER (PARTITION BY account_id) AS DOUBLE)) - 1) * 100')} "
    "AS vs_average_pct FROM (SELECT account_id, " + O.cal_month("date") + " AS cal_month, "
    "sum(amount) AS total, count(*) AS txn_count FROM ledger WHERE transaction_type = 'Debit' GROUP BY 1, 2)"))
def q_seasonal_by_account(spark, sf_dir):
    return trends.seasonal_patterns(ledger_of(spark, sf_dir), by=ACCT)


@register("what_if_by_account", O.over_ledger(
    "SELECT m.account_id, m.category, "
    + ", ".join([
        f"{O.r2('CAST(total AS DOUBLE) / CAST(months AS DOUBLE)')} AS current_monthly_avg",
        "reduction_pct",
        f"{O.r2('(CAST(total AS DOUBLE) / CAST(months AS DOUBLE) * (reduction_pct / 100))')} AS monthly_saving",
        f"{O.r2('(CAST(total AS DOUBLE) / CAST(months AS DOUBLE) * (reduction_pct / 100)) * 12')} AS annual_saving",
        f"{O.r2('CAST(total AS DOUBLE) / CAST(months AS DOUBLE) - (CAST(total AS DOUBLE) / CAST(months AS DOUBLE) * (reduction_pct / 100))')} AS new_monthly_avg",
    ])
    + " FROM (SELECT account_id, category, sum(m) AS total, count(*) AS months FROM (SELECT account_id, category, "
    "month, sum(amount) AS m FROM ledger WHERE transaction_type = 'Debit' GROUP BY account_id, category, month) "
    "GROUP BY account_id, category HAVING sum(m) <> 0) m JOIN sc ON m.category = sc.category",
    "sc(category, reduction_pct) AS (VALUES " + ", ".join(f"({O._q(c)}, CAST({p} AS DOUBLE))" for c, p in SCENARIOS) + ")"))
def q_what_if_by_account(spark, sf_dir):
    return habits.what_if(ledger_of(spark, sf_dir), habits.scenarios(spark, SCENARIOS), by=ACCT)


# ---------------------------------------------------------------- options and further per-account forms


@register("discretionary_recent", O.over_ledger(
    "SELECT category, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS txn_count, "
    "CAST(sum(amount) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_amount FROM ("
    "SELECT *, dense_rank() OVER (ORDER BY month DESC) AS age FROM ledger "
    f"WHERE transaction_type = 'Debit' AND category IN {O.DISCRETIONARY_IN}) WHERE age <= 6 GROUP BY category"))
def q_discretionary_recent(spark, sf_dir):
    return habits.discretionary(ledger_of(spark, sf_dir), months=6)


@register("budget_vs_actual_all_months", O.over_ledger(
    _bva_sql().replace(f" AND month = '{AS_OF_MONTH}'", "").replace(f"'{AS_OF_MONTH}' AS month", "CAST(NULL AS VARCHAR) AS month"),
    _budget_log_sql()))
def q_budget_vs_actual_all(spark, sf_dir):
    led = ledger_of(spark, sf_dir)
    return budget.budget_vs_actual(led, _current(led), None)


@register("rule_allocation_by_account", O.over_ledger(
    "SELECT account_id, month, CAST(income AS DOUBLE) AS income, "
    f"{O.r2('CAST(income * 0.5 AS DOUBLE)')} AS needs, {O.r2('CAST(income * 0.3 AS DOUBLE)')} AS wants, "
    f"{O.r2('CAST(income * 0.2 AS DOUBLE)')} AS savings FROM (SELECT account_id, month, "
    "sum(CASE WHEN transaction_type = 'Credit' THEN amount ELSE 0 END) AS income FROM ledger GROUP BY account_id, month)"))
def q_rule_allocation_by_account(spark, sf_dir):
    return budget.rule_allocation(ledger_of(spark, sf_dir), by=ACCT)


def _subs_total_sql(by: str = "") -> str:
    sel, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (f"SELECT {sel}count(*) AS subscriptions, CAST(sum(CAST(estimated_annual AS DECIMAL(18,2))) AS DOUBLE) AS total_annual "
            f"FROM ({_subs_sql(by)}){group}")


@register("subscription_total", O.over_ledger(_subs_total_sql()))
def q_subscription_total(spark, sf_dir):
    return habits.subscription_total(habits.subscription_audit(ledger_of(spark, sf_dir)))


@register("subscription_total_by_account", O.over_ledger(_subs_total_sql("account_id")))
def q_subscription_total_by_account(spark, sf_dir):
    return habits.subscription_total(habits.subscription_audit(ledger_of(spark, sf_dir), ACCT), ACCT)


@register("category_breakdown_by_account", O.over_ledger(
    "SELECT account_id, category, CAST(sum(amount) AS DOUBLE) AS total FROM ledger WHERE transaction_type = 'Debit' GROUP BY account_id, category"))
def q_category_breakdown_by_account(spark, sf_dir):
    return summary.category_breakdown(ledger_of(spark, sf_dir), "Debit", ACCT)


@register("category_month_by_account", O.over_ledger(
    "SELECT account_id, month, category, CAST(sum(amount) AS DOUBLE) AS total FROM ledger "
    "WHERE transaction_type = 'Debit' AND category IS NOT NULL GROUP BY account_id, month, category"))
def q_category_month_by_account(spark, sf_dir):
    return summary.category_month(ledger_of(spark, sf_dir), ACCT)


@register("budgets_current_by_account", O.over_ledger(
    "SELECT account_id, category, CAST(monthly_limit AS DOUBLE) AS monthly_limit FROM budgets", _budget_log_sql("account_id")))
def q_budgets_current_by_account(spark, sf_dir):
    return _current(ledger_of(spark, sf_dir), ACCT).select("account_id", "category", F.col("monthly_limit").cast("double").alias("monthly_limit"))


_FILLED = (
    "real AS (SELECT * FROM monthly WHERE regexp_matches(month, '^[0-9]{4}-(0[1-9]|1[0-2])$')), "
    "filled AS (SELECT account_id, month, sum(income) AS income, sum(expenses) AS expenses, sum(savings) AS savings FROM ("
    "SELECT account_id, month, income, expenses, savings FROM monthly UNION ALL "
    "SELECT account_id, strftime(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)), '%Y-%m'), 0, 0, 0 FROM ("
    "SELECT account_id, CAST(min(month) || '-01' AS DATE) AS lo, CAST(max(month) || '-01' AS DATE) AS hi FROM real GROUP BY account_id)) "
    "GROUP BY account_id, month)")


@register("monthly_trends_filled_by_account", catalog_trends_sql("account_id", _FILLED, "filled"))
def q_monthly_trends_filled(spark, sf_dir):
    return trends.monthly_trends(ledger_of(spark, sf_dir), ACCT, fill_gaps=True)


@register("ledger_raw_hash", O.over_ledger(
    "SELECT account_id, row_seq, h AS hash, " + O.dbl("amount") + " AS amount FROM (SELECT *, row_number() OVER (PARTITION BY account_id, h ORDER BY row_seq) AS rn3 FROM ("
    "SELECT *, sha256(concat_ws('|', date, coalesce(description, ''), regexp_replace(CAST(amount AS VARCHAR), '0$', ''), transaction_type)) AS h FROM hashed)) WHERE rn3 = 1"))
def q_ledger_raw_hash(spark, sf_dir):
    led = ingest.build_ledger(statements(spark, sf_dir), hash_on="raw")
    return led.select("account_id", "row_seq", "hash", F.col("amount").cast("double").alias("amount"))
