"""Keyword labelling and transaction classification as column expressions.

The ordered keyword dictionary is one trie-shaped regular expression, evaluated once for each text: a look-ahead at
every position finds the longest keyword that starts there. All other keywords that start there are prefixes of it, so each keyword stands for the
first category, in dictionary order, of its own prefixes; the first category of all positions wins, exactly like the nested
loop it replaces. It all stays inside whole-stage codegen.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from finledger.taxonomy import (
    ALL_EXPENSE_CATEGORIES,
    ALL_INCOME_CATEGORIES,
    ALL_SAVINGS_CATEGORIES,
    CONFIDENCE_THRESHOLD,
    EXPENSE,
    INCOME,
    SAVINGS,
    ordered_categories,
)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)


def _trie_pattern(words: list[str]) -> str:
    """A pattern that matches the longest of some words; common beginnings are written once."""
    starts: dict[str, list[str]] = {}
    for w in words:
        if w:
            starts.setdefault(w[0], []).append(w[1:])
    branches = []
    for first, rests in starts.items():
        common = os.path.commonprefix(rests)
        branches.append(_quote(first + common) + _trie_pattern([r[len(common):] for r in rests]))
    if not branches:
        return ""
    if len(branches) == 1 and "" not in words:
        return branches[0]
    return "(?:" + "|".join(branches) + ")" + ("?+" if "" in words else "")


@functools.cache
def _keyword_table() -> tuple[str, list[str], list[int], list[str]]:
    """The pattern, the keywords, of each keyword the number of the first category among its prefixes, and the categories."""
    categories, number = [], {}
    for i, (_, _, category, keywords) in enumerate(ordered_categories()):
        categories.append(category)
        for k in keywords:
            number.setdefault(k, i)
    words = sorted(number)
    best = [min(n for k, n in number.items() if w.startswith(k)) for w in words]
    firsts = "".join(sorted({w[0] for w in words}))
    return f"(?=[{firsts}])(?=({_trie_pattern(words)}))", words, best, categories


def _word_category(text: Column) -> Column:
    """Stricter matching (decision D2): a keyword must stand between characters that are none of words."""
    expr = F
    for _, _, category, keywords in ordered_categories():
        hit = text.rlike(r"(?U)(^|\W)(" + "|".join(map(_quote, keywords)) + r")($|\W)")
        expr = expr.when(hit, F.lit(category))
    return expr


def keyword_category(processed: str | Column, mode: str = "substring") -> Column:
    """Category of the first keyword hit in priority order, or null."""
    text = _c(processed)
    if mode == "word":
        return _word_category(text)
    if mode != "substring":
        raise ValueError(f"unknown keyword mode {mode!r}")
    pattern, words, best, categories = _keyword_table()
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    first = F.array_min(F.transform(hits, lambda h: F.get(F.lit(best), (F.array_position(F.lit(words), h) - 1).cast("int"))))
    return F.get(F.lit(categories), first)


def label_group_of(category: str | Column) -> Column:
    """Label group (Expense / Savings/Investment / Income) of a taxonomy category."""
    c = _c(category)
    return (
        F.when(c.isin(ALL_EXPENSE_CATEGORIES), F.lit(EXPENSE))
        .when(c.isin(ALL_SAVINGS_CATEGORIES), F.lit(SAVINGS))
        .when(c.isin(ALL_INCOME_CATEGORIES), F.lit(INCOME))
    )


def classify_columns(
    is_credit: Column,
    kw_category: Column,
    ml_type: Column | None = None,
    ml_type_conf: Column | None = None,
    ml_savings: Column | None = None,
    ml_savings_conf: Column | None = None,
    ml_expense: Column | None = None,
    ml_expense_conf: Column | None = None,
    threshold: float = CONFIDENCE_THRESHOLD,
) -> dict[str, Column]:
    """C4: transaction_type, category, is_saving.

    Credit: (Credit, keyword category, 0). Debit: the keyword group, else the
    ML debit type when its confidence is strictly above ``threshold``, else
    Expense; is_saving iff the group starts with "savings"; a missing category
    is filled by the matching ML model above the threshold. ML columns are
    optional: without them every keyword miss is an uncategorised Expense.
    """
    lit_null = F.lit(None).cast("string")
    kw_group = label_group_of(kw_category)
    ml_t = (
        F.when(ml_type_conf > F.lit(threshold), ml_type) if ml_type is not None else lit_null
    )
    debit_group = F.coalesce(kw_group, ml_t, F.lit(EXPENSE))
    saving = F.lower(debit_group).startswith("savings")
    ml_s = F.when(ml_savings_conf > F.lit(threshold), ml_savings) if ml_savings is not None else lit_null
    ml_e = F.when(ml_expense_conf > F.lit(threshold), ml_expense) if ml_expense is not None else lit_null
    debit_category = F.coalesce(kw_category, F.when(saving, ml_s).otherwise(ml_e))
    return {
        "transaction_type": F.when(is_credit, F.lit("Credit")).otherwise(F.lit("Debit")),
        "category": F.when(is_credit, kw_category).otherwise(debit_category),
        "is_saving": F.when(~is_credit & saving, F.lit(1)).otherwise(F.lit(0)),
    }


def stored_label_group(is_saving: str | Column = "is_saving", txn_type: str | Column = "transaction_type") -> Column:
    """Label group shown for a stored row (saving, then credit, then expense)."""
    return (
        F.when(_c(is_saving) == 1, F.lit(SAVINGS))
        .when(_c(txn_type) == "Credit", F.lit(INCOME))
        .otherwise(F.lit(EXPENSE))
    )


def display_category(category: str | Column = "category") -> Column:
    """Null or empty category shown as ``Uncategorized``."""
    return F.coalesce(F.nullif(_c(category), F.lit("")), F.lit("Uncategorized"))
