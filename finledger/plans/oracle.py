"""Oracle SQL (DuckDB dialect) for the registered queries.

``LEDGER_CTE`` rebuilds the whole ingest in SQL over the ``orders`` view:
the statement derivation, normalisation, date parsing, keyword labels,
classification, hash and first-copy de-duplication. Each query appends its
own SELECT. The keyword CASE is generated from the same fixed taxonomy the
Spark side uses.
"""

from __future__ import annotations

from string import Formatter

from finledger.functions.text import STRIPPED
from finledger.taxonomy import (
    ALL_SAVINGS_CATEGORIES,
    DISCRETIONARY_CATEGORIES,
    MONTH_NAMES,
    NEEDS_CATEGORIES,
    ordered_categories,
)

STATEMENT_CTE = r"""
tmpl(idx, narration, is_credit) AS (VALUES
 (0,'Zomato Order',0),(1,'SWIGGY DELIVERY',0),(2,'BIGBASKET',0),(3,'UBER RIDE',0),(4,'AMAZON PRIME',0),
 (5,'NETFLIX SUBSCRIPTION',0),(6,'Cesc Limited Bill',0),(7,'HPCL PETROL',0),(8,'APOLLO PHARMACY',0),(9,'UDEMY COURSE',0),
 (10,'HOUSE  RENT',0),(11,'BOOKMYSHOW',0),(12,'MAKEMYTRIP FLIGHT',0),(13,'URBANCLAP SALON',0),(14,'SIP MUTUAL FUND',0),
 (15,'LIC PREMIUM',0),(16,'CARD PAYMENT',0),(17,'NEFT TRANSFER',0),(18,'gym recurring fee',0),(19,'RANDOM MERCHANT',0),
 (20,'SALARY CREDIT',1),(21,'RENT RECEIVED',1),(22,'REFUND AMAZON',1),(23,'INT PAID',1),(24,'FREELANCE WORK',1),(25,'MISC DEPOSIT',1)),
base AS (SELECT o_custkey AS account_id, o_orderkey AS row_seq, CAST(o_orderkey % 26 AS INT) AS idx,
   CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS amt FROM orders),
raw0 AS (SELECT b.account_id, b.row_seq,
   CASE WHEN b.row_seq % 91 = 0 THEN iso||' 10:00:00' ELSE CASE b.row_seq % 7 WHEN 0 THEN iso
     WHEN 1 THEN substr(iso,9,2)||'-'||substr(iso,6,2)||'-'||substr(iso,1,4)
     WHEN 2 THEN substr(iso,9,2)||'/'||substr(iso,6,2)||'/'||substr(iso,1,4)
     WHEN 3 THEN substr(iso,6,2)||'/'||substr(iso,9,2)||'/'||substr(iso,1,4)
     WHEN 4 THEN substr(iso,1,4)||'/'||substr(iso,6,2)||'/'||substr(iso,9,2)
     WHEN 5 THEN substr(iso,9,2)||'-'||substr('JanFebMarAprMayJunJulAugSepOctNovDec',(CAST(substr(iso,6,2) AS INT)-1)*3+1,3)||'-'||substr(iso,1,4)
     ELSE CASE WHEN b.row_seq % 196 = 6 THEN ' ' WHEN b.row_seq % 14 = 6 THEN 'bad date'
       WHEN b.row_seq % 28 = 13 THEN chr(9)||iso||' '||chr(9)
       ELSE substr(iso,1,4)||'/'||CAST(CAST(substr(iso,6,2) AS INT) AS STRING)||'/?'||substr(iso,9,2) END END END AS date_text,
   CASE WHEN t.idx = 18 OR t.idx = 5 THEN t.narration ELSE t.narration||'-'||lpad(CAST(b.row_seq AS STRING),8,'0')||CASE WHEN b.row_seq % 61 = 0 THEN '|500.0' ELSE '' END END AS narration,
   CASE WHEN b.row_seq % 97 = 0 THEN 'abc' WHEN t.is_credit = 1 THEN '0' ELSE amt END AS debit_text,
   CASE WHEN t.is_credit = 1 AND b.row_seq % 97 <> 0 THEN amt ELSE '0' END AS credit_text
   FROM base b JOIN tmpl t ON b.idx = t.idx),
statement AS (SELECT * FROM raw0 UNION ALL
   SELECT account_id, row_seq + 1000000000, date_text, narration, debit_text, credit_text FROM raw0 WHERE row_seq % 50 = 0)"""

_DATE_FORMATS_SQL = ["%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%b-%Y"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def filled(template: str, **values: str) -> str:
    """A text template with ``{name}`` places as one SQL string expression."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts += [_q(text)] if text else []
        parts += [f"CAST({values[name]} AS VARCHAR)"] if name else []
    return " || ".join(parts)


def _in_list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def keyword_case(col: str = "processed") -> str:
    branches = []
    for _, _, cat, kws in ordered_categories():
        cond = " OR ".join(f"contains({col}, {_q(k)})" for k in kws)
        branches.append(f"WHEN {cond} THEN {_q(cat)}")
    return "CASE " + " ".join(branches) + " END"


def month_names_sql() -> str:
    return "[" + ", ".join(_q(m) for m in MONTH_NAMES) + "]"


SAVINGS_IN = _in_list(ALL_SAVINGS_CATEGORIES)
NEEDS_IN = _in_list(NEEDS_CATEGORIES)
DISCRETIONARY_IN = _in_list(DISCRETIONARY_CATEGORIES)

# every kind of whitespace that Python's strip() removes
_stripped = "trim(date_text, " + " || ".join(f"chr({ord(c)})" for c in STRIPPED) + ")"
_parsed_date = "coalesce(" + ", ".join(
    f"try_strptime({_stripped}, '{f}')" for f in _DATE_FORMATS_SQL) + ")"


def cal_month(date: str) -> str:
    """``CAST(substr(date, 6, 2) AS INTEGER)`` as SQLite does it: the leading signed digits, else 0."""
    return f"coalesce(TRY_CAST(regexp_extract(substr({date}, 6, 2), '^\\s*([+-]?[0-9]+)', 1) AS INT), 0)"


LINES_CTE = f"""
parsed AS (
  SELECT account_id, row_seq, date_text, narration AS description,
    trim(regexp_replace(regexp_replace(upper(coalesce(narration, '')), '-[0-9]{{6,}}', '', 'g'), '\\s+', ' ', 'g')) AS processed,
    coalesce(strftime({_parsed_date}, '%Y-%m-%d'), {_stripped}) AS date,
    coalesce(TRY_CAST(debit_text AS DOUBLE), 0) AS dr,
    coalesce(TRY_CAST(credit_text AS DOUBLE), 0) AS cr
  FROM statement),
lines AS (
  SELECT *, cr > 0 AS is_credit,
    TRY_CAST(CASE WHEN cr > 0 THEN cr WHEN dr > 0 THEN dr END AS DECIMAL(18,2)) AS amount,
    {keyword_case('processed')} AS kw_category
  FROM parsed),
classified AS (
  SELECT account_id, row_seq, date, substr(date, 1, 7) AS month, description, processed, amount,
    CASE WHEN is_credit THEN 'Credit' ELSE 'Debit' END AS transaction_type,
    kw_category AS category,
    CASE WHEN NOT is_credit AND kw_category IN {SAVINGS_IN} THEN 1 ELSE 0 END AS is_saving
  FROM lines WHERE amount IS NOT NULL),
hashed AS (
  SELECT *, sha256(concat_ws('|', date, processed, regexp_replace(CAST(amount AS VARCHAR), '0$', ''), transaction_type)) AS hash
  FROM classified),
ledger AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, hash ORDER BY row_seq) AS rn FROM hashed)
  WHERE rn = 1)"""

PREFIX = "WITH " + STATEMENT_CTE.strip() + "," + LINES_CTE


def over_ledger(select_sql: str, extra_ctes: str = "") -> str:
    """Full oracle statement: the ledger CTEs, optional extra CTEs, then the query."""
    extra = ("," + extra_ctes) if extra_ctes.strip() else ""
    return PREFIX + extra + "\n" + select_sql


def r2(x: str) -> str:
    return f"CAST(floor(({x}) * 100 + 0.5) / 100 AS DOUBLE)"


def r1(x: str) -> str:
    return f"CAST(floor(({x}) * 10 + 0.5) / 10 AS DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"
