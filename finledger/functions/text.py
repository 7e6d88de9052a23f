"""Row-level column expressions: description, date, amount, hash (C1, C2, C5, IO1).

All are built-in Spark expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from finledger.taxonomy import DATE_FORMATS

# (?U): \d and \s are Unicode-aware, as in Python's ``re``.
_REF_NUMBER = r"(?U)-\d{6,}"
_WHITESPACE = r"(?U)\s+"
# What pandas.to_numeric accepts as a number (plus inf / nan spellings).
_NUMERIC = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)inf(inity)?|(?i)nan)\s*$"


# What Python's ``str.strip()`` removes.
STRIPPED = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
            "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.trim(_c(col).cast("string"), F.lit(STRIPPED))


def normalize_description(col: str | Column) -> Column:
    """Null -> '', upper case, drop ``-<6+ digits>`` references, collapse whitespace."""
    up = F.upper(F.coalesce(_c(col), F.lit("")))
    no_ref = F.regexp_replace(up, _REF_NUMBER, "")
    return F.trim(F.regexp_replace(no_ref, _WHITESPACE, " "))


# Shape of the text each format can parse (strptime: %Y is exactly 4 digits,
# %m and %d 1 or 2, %b a 3-letter month). A format is only tried on text of
# its shape, so the common case raises no parser exception at all.
_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
}


def parse_date_value(col: str | Column) -> Column:
    """C2 as a date: the first of six formats that parses, else null."""
    raw = strip(col)
    return F.coalesce(*[F.when(raw.rlike(_SHAPES[fmt]), F.try_to_date(raw, fmt)) for fmt in DATE_FORMATS])


def format_date(parsed: str | Column, col: str | Column) -> Column:
    """C2 text: ``yyyy-MM-dd`` of the parsed date, else the stripped original text (a missing cell is blank)."""
    return F.coalesce(F.date_format(_c(parsed), "yyyy-MM-dd"), strip(col), F.lit(""))


def parse_date(col: str | Column) -> Column:
    """The first of six formats that parses gives ``yyyy-MM-dd``; else the trimmed text."""
    return format_date(parse_date_value(col), col)


def parse_amount(col: str | Column) -> Column:
    """IO1: text -> double; anything pandas would coerce to NaN becomes 0.0.

    Spark accepts ``5d``/``5f`` and yields NaN for ``nan``; both are guarded so
    the value is 0.0 exactly when pandas would give NaN.
    """
    txt = _c(col).cast("string")
    as_double = F.when(txt.rlike(_NUMERIC), F.trim(txt).try_cast("double"))
    return F.coalesce(F.nanvl(as_double, F.lit(0.0)), F.lit(0.0))


def to_money(col: str | Column) -> Column:
    """Positive finite double -> decimal(18,2); null when it does not fit."""
    return _c(col).try_cast("decimal(18,2)")


def python_float_text(amount: str | Column) -> Column:
    """Text of a cent amount exactly as Python prints the float (``500.0``, ``12.5``, ``12.34``)."""
    return F.regexp_replace(_c(amount).cast("string"), "0$", "")


def txn_hash(date: str | Column, processed: str | Column, amount: str | Column, txn_type: str | Column) -> Column:
    """sha256 of ``date|processed|amount|type``."""
    return F.sha2(F.concat_ws("|", _c(date), _c(processed), python_float_text(amount), _c(txn_type)), 256)


def filled(template: str, **values: Column) -> Column:
    """A text template with ``{name}`` places as one string column."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [values[name].cast("string")] if name else []
    return F.concat(*parts)


def month_of(date: str | Column) -> Column:
    """``substr(date, 1, 7)``: the month group, raw prefix for unparsed dates."""
    return F.substring(_c(date), 1, 7)


def cal_month_of(date: str | Column) -> Column:
    """``CAST(substr(date, 6, 2) AS INTEGER)`` by SQLite's rule: the leading signed digits, else 0."""
    digits = F.regexp_extract(F.substring(_c(date), 6, 2), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def round_half_up(col: str | Column, digits: int) -> Column:
    """Deterministic rounding of a double: floor(x*10^d + 0.5) / 10^d."""
    scale = 10 ** digits
    return (F.floor(_c(col) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")
