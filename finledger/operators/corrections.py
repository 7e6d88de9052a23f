"""Category corrections (C6, J7, M4) and the training bag (IO4).

A correction is an event (hash, category, is_saving, corrected_at). The
latest event per hash wins; the ledger view applies it with a null-safe equi-join
on (account, hash) and ``coalesce``. Every correction also adds one training
example (the processed description with the new category).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finledger.operators.ingest import ACCOUNT_KEY, same_key, training_rows

CORRECTION_SCHEMA = "account_id long, hash string, category string, is_saving int, corrected_at timestamp"


def latest_corrections(corrections: DataFrame, key: Sequence[str] = ACCOUNT_KEY) -> DataFrame:
    """One row per (key, hash): the most recent correction."""
    at = F.coalesce(F.col("corrected_at"), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    latest = F.max_by(F.struct("category", "is_saving"), at)
    return corrections.groupBy(*key, "hash").agg(latest.alias("c")).select(
        *key, "hash", F.col("c.category").alias("new_category"), F.col("c.is_saving").alias("new_is_saving"))


def apply_corrections(ledger: DataFrame, corrections: DataFrame, key: Sequence[str] = ACCOUNT_KEY) -> DataFrame:
    """The ledger with corrected category and is_saving (other columns unchanged)."""
    other, same = same_key(latest_corrections(corrections, key), key)
    j = ledger.join(other, same, "left")
    return j.select(
        *[
            F.coalesce(F.col("new_category"), F.col("category")).alias("category") if c == "category"
            else F.coalesce(F.col("new_is_saving"), F.col("is_saving")).alias("is_saving") if c == "is_saving"
            else F.col(c)
            for c in ledger.columns
        ]
    )


def correction_training_rows(ledger: DataFrame, corrections: DataFrame, key: Sequence[str] = ACCOUNT_KEY) -> DataFrame:
    """IO4 for corrections: one (processed description, category) per correction event
    that matches a stored row."""
    other, same = same_key(ledger.select(*key, "hash", "processed"), key)
    return corrections.join(other, same).select(F.col("processed").alias("description"), "category")


def training_bag(ledger: DataFrame, corrections: DataFrame | None = None,
                 key: Sequence[str] = ACCOUNT_KEY) -> DataFrame:
    """The training bag: categorised ingested rows plus one example per correction."""
    bag = training_rows(ledger)
    if corrections is not None:
        bag = bag.unionByName(correction_training_rows(ledger, corrections, key))
    return bag


def weighted_bag(bag: DataFrame) -> DataFrame:
    """The bag as (description, category, weight): duplicates weigh the model,
    so counting them is exactly equivalent and far smaller to train on."""
    return bag.groupBy("description", "category").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def rule_corrections(ledger: DataFrame, rules: dict[str, tuple[str, int]], at: str = "2002-01-01 00:00:00",
                     key: Sequence[str] = ACCOUNT_KEY) -> DataFrame:
    """Corrections a user would make for every uncategorised row whose
    processed description equals a rule's text: (category, is_saving)."""
    cond = None
    cat = None
    sav = None
    for text, (category, is_saving) in rules.items():
        hit = F.col("processed") == text
        cond = hit if cond is None else cond | hit
        cat = F.when(hit, F.lit(category)) if cat is None else cat.when(hit, F.lit(category))
        sav = F.when(hit, F.lit(is_saving)) if sav is None else sav.when(hit, F.lit(is_saving))
    return ledger.where(F.col("category").isNull() & cond).select(
        *key, "hash", cat.alias("category"), sav.cast("int").alias("is_saving"),
        F.lit(at).cast("timestamp").alias("corrected_at"),
    )
