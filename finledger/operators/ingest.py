"""Statement lines -> classified, de-duplicated ledger rows (IO2-IO5, C1-C5, W8, J2, U2).

One logical plan: narrow column expressions for parsing and labelling, then
a single shuffle on (account, hash) to keep the first copy of each
transaction. The de-duplication is an aggregate with map-side partial
combining, so one hot transaction repeated a billion times is collapsed
before the shuffle instead of landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finledger.functions.classify import classify_columns, keyword_category
from finledger.functions.text import (
    month_of,
    normalize_description,
    parse_amount,
    format_date,
    parse_date_value,
    to_money,
    txn_hash,
)

LEDGER_COLUMNS = [
    "account_id", "source_file", "row_seq", "date", "month", "txn_date", "description", "processed",
    "amount", "transaction_type", "category", "is_saving", "hash",
]
ACCOUNT_KEY = ("account_id",)


NO_AMOUNT, TOO_LARGE = "no positive amount", "amount too large"


def line_amount() -> Column:
    """The double a line stands for: a positive credit, else a positive debit, else null."""
    dr, cr = parse_amount("debit_text"), parse_amount("credit_text")
    return F.when(cr > 0, cr).when(dr > 0, dr)


def parse_lines(statements: DataFrame, keyword_mode: str = "substring") -> DataFrame:
    """IO1/IO2 + C1-C3 on every statement line; ``keep`` is false for lines that are dropped.

    A line is kept when its credit is positive (credit wins) or else its debit
    is positive, and the amount fits decimal(18,2).
    """
    dated = statements.withColumn("txn_date", parse_date_value("date_text"))
    lines = dated.select(
        "account_id", "source_file", "row_seq",
        format_date("txn_date", "date_text").alias("date"),
        "txn_date",
        F.col("narration").alias("description"),
        normalize_description("narration").alias("processed"),
        (parse_amount("credit_text") > 0).alias("is_credit"),
        to_money(line_amount()).alias("amount"),
    )
    return lines.select(
        "*",
        F.col("amount").isNotNull().alias("keep"),
        keyword_category(F.col("processed"), keyword_mode).alias("kw_category"),
    )


def _classified(lines: DataFrame, ml_cols: dict | None = None, hash_on: str = "processed") -> DataFrame:
    ml_cols = ml_cols or {}
    cols = classify_columns(F.col("is_credit"), F.col("kw_category"), **ml_cols)
    out = lines.select(
        "account_id", "source_file", "row_seq", "date",
        month_of("date").alias("month"),
        "txn_date",
        "description", "processed", "amount",
        cols["transaction_type"].alias("transaction_type"),
        cols["category"].alias("category"),
        cols["is_saving"].alias("is_saving"),
    )
    if hash_on not in ("processed", "raw"):
        raise ValueError(f"unknown hash_on {hash_on!r}")
    text = F.col("processed") if hash_on == "processed" else F.coalesce("description", F.lit(""))
    return out.withColumn("hash", txn_hash("date", text, "amount", "transaction_type")).select(*LEDGER_COLUMNS)


def prepare_transactions(statements: DataFrame, models=None, keyword_mode: str = "substring",
                         keep_dropped: bool = False, hash_on: str = "processed") -> DataFrame:
    """C4 + C5 for every kept line (before de-duplication).

    ``hash_on="raw"`` hashes the narration as written, so payments that differ
    only in a reference number stay apart (decision D6).

    ``keep_dropped=True`` also returns the dropped lines (null ``amount``) so a
    caller can remove them after its own aggregate: a filter here is pushed
    down to the scan, below the repartition that spreads a single-split source
    over the cores, and would then run in one task.

    ``models``: an optional trained :class:`finledger.operators.ml.LedgerModels`
    snapshot (decision D3: the model is fixed for the whole batch). Only the
    distinct processed texts of debit lines that missed every keyword are
    scored; the scores join back on the text. The scored texts are a small
    dimension in practice (AQE broadcasts them at runtime); when they are not,
    the join is a sort-merge join with AQE skew splitting.
    """
    lines = parse_lines(statements, keyword_mode)
    if not keep_dropped:
        lines = lines.where("keep")
    if models is None:
        return _classified(lines, hash_on=hash_on)
    needs_ml = ((~F.col("is_credit")) & F.col("kw_category").isNull()).cast("int")
    # distinct texts that need a model; filtering after the aggregate keeps the
    # keyword CASE evaluated once per line (a pushed-down filter would repeat it)
    texts = lines.groupBy("processed").agg(F.max(needs_ml).alias("needs_ml")).where("needs_ml = 1")
    scored = models.score(texts.select("processed"), "processed")
    joined = lines.join(scored, on="processed", how="left")
    return _classified(joined, models.classify_kwargs(), hash_on)


def first_per_hash(tx: DataFrame, key: Sequence[str] = ACCOUNT_KEY) -> DataFrame:
    """IO3/W8/M5: keep the first kept copy of each (key, hash), by (source_file, row_seq).

    ``min`` of a struct ordered by (source_file, row_seq) picks the first copy;
    as an aggregate it combines map-side, so hot keys never skew a task. Dropped
    lines (null amount) never win: their hash text lacks the amount, so it can
    equal that of a kept line. Null keys form a group of their own.
    """
    rest = [c for c in tx.columns if c not in (*key, "hash", "source_file", "row_seq")]
    first = F.min(F.when(F.col("amount").isNotNull(), F.struct("source_file", "row_seq", *rest))).alias("first")
    return tx.groupBy(*key, "hash").agg(first).where(F.col("first").isNotNull()).select(
        *key, "hash", "first.*"
    ).select(*tx.columns)


def same_key(other: DataFrame, key: Sequence[str]) -> tuple[DataFrame, Column]:
    """``other`` with its (key, hash) renamed, and the null-safe condition that joins it on them."""
    names = [*key, "hash"]
    renamed = other.select(*[F.col(c).alias(f"_other_{c}") if c in names else F.col(c) for c in other.columns])
    cond = F.col(names[0]).eqNullSafe(F.col(f"_other_{names[0]}"))
    for c in names[1:]:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_other_{c}"))
    return renamed, cond


def new_rows(tx: DataFrame, stored: DataFrame | None = None, key: Sequence[str] = ACCOUNT_KEY) -> DataFrame:
    """First copies whose (key, hash) is not in the stored ledger yet (null accounts match null accounts).

    Stored keys meet the transactions in the aggregate that finds the first copies, so whole rows are dealt once only.
    """
    if stored is None:
        return first_per_hash(tx, key)
    groups = [*key, "hash"]
    rest = [c for c in tx.columns if c not in (*groups, "source_file", "row_seq")]
    line = F.struct("source_file", "row_seq", *rest)
    lines = tx.select(*groups, F.when(F.col("amount").isNotNull(), line).alias("line"), F.lit(False).alias("known"))
    keys = stored.select(*groups, F.lit(None).cast(lines.schema["line"].dataType).alias("line"), F.lit(True).alias("known"))
    met = lines.unionByName(keys).groupBy(*groups).agg(F.min("line").alias("first"), F.max("known").alias("known"))
    return met.where(F.col("first").isNotNull() & ~F.col("known")).select(*groups, "first.*").select(*tx.columns)


def build_ledger(statements: DataFrame, models=None, key: Sequence[str] = ACCOUNT_KEY, hash_on: str = "processed") -> DataFrame:
    """Statement lines -> ledger rows (first ingest of an empty ledger)."""
    return new_rows(prepare_transactions(statements, models, keep_dropped=True, hash_on=hash_on), None, key)


def ingest_report(statements: DataFrame, stored: DataFrame | None = None,
                  key: Sequence[str] = ACCOUNT_KEY, by: Sequence[str] = ()) -> DataFrame:
    """IO5: total_rows, inserted, skipped (duplicates), dropped (no positive amount), uncategorized.

    One row per ``by`` key. ``skipped`` counts every kept line that was not
    inserted: repeats inside the batch and lines already stored.
    """
    # one pass: lines of one (key, hash) are counted together; the category follows from the hashed text
    tx = prepare_transactions(statements, keep_dropped=True)
    groups = [*key, *[c for c in by if c not in key], "hash"]
    kept = F.col("amount").isNotNull()
    g = tx.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), F.max(F.when(kept, F.col("category"))).alias("category"))
    if stored is not None:
        other, same = same_key(stored.select(*key, "hash").distinct().withColumn("_known", F.lit(True)), key)
        g = g.join(other, same, "left")
        known = F.coalesce(F.col("_known"), F.lit(False))
    else:
        known = F.lit(False)
    new = (F.col("kept") > 0) & ~known
    zero = F.lit(0).cast("long")

    def total(c):
        return F.coalesce(F.sum(c), zero).cast("long")

    return g.groupBy(*by).agg(
        total(F.col("n")).alias("total_rows"), total(new.cast("long")).alias("inserted"),
        (total(F.col("kept")) - total(new.cast("long"))).alias("skipped"),
        total(F.col("n") - F.col("kept")).alias("dropped"),
        total((new & F.col("category").isNull()).cast("long")).alias("uncategorized"),
    )


def dropped_lines(statements: DataFrame) -> DataFrame:
    """IO1/IO5: the lines that an ingest drops, as they were read, each with the reason.

    ``TOO_LARGE``: a positive amount (infinity too) that decimal(18,2) cannot hold, so money that is
    missing from the ledger; ``NO_AMOUNT``: blank, unparsable, zero or negative in both columns.
    """
    lines = statements.withColumn("_amount", line_amount())
    return lines.where(to_money("_amount").isNull()).select(
        "account_id", "source_file", "row_seq", F.col("narration").alias("description"), "debit_text", "credit_text",
        F.when(F.col("_amount").isNull(), F.lit(NO_AMOUNT)).otherwise(F.lit(TOO_LARGE)).alias("reason"))


def uncategorized_report(inserted: DataFrame) -> DataFrame:
    """IO5: the uncategorised rows of an ingest (description, amount, type, hash)."""
    return inserted.where(F.col("category").isNull()).select(
        "account_id", "row_seq", "description",
        F.col("amount").cast("double").alias("amount"),
        F.col("transaction_type").alias("type"), "hash",
    )


def training_rows(inserted: DataFrame) -> DataFrame:
    """IO4: one training example (processed text, category) per categorised inserted row."""
    return inserted.where(F.col("category").isNotNull()).select(
        F.col("processed").alias("description"), "category"
    )
