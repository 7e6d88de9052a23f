"""Row-level ledger views: pages, slices, search, labels (IO6, O1, P1-P3, P7, P8).

Filters are plain predicates so Catalyst pushes them into the Parquet scan;
``month`` filters hit the ``month`` partition column of a stored ledger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finledger.functions.classify import stored_label_group
from finledger.operators._common import as_double
from finledger.taxonomy import ordered_categories

ROW_COLUMNS = ["account_id", "row_seq", "date", "description", "amount", "transaction_type",
               "category", "is_saving", "hash"]


def _rows(ledger: DataFrame) -> DataFrame:
    return ledger.select(*[as_double(c).alias(c) if c == "amount" else c for c in ROW_COLUMNS])


def newest_first(ledger: DataFrame) -> list:
    """A total order: row numbers restart in each file and upload, so file and hash break the last ties."""
    return [F.col("date").desc(), F.col("row_seq").desc(), F.col("account_id").desc(),
            F.col("source_file").desc(), F.col("hash")]


def ledger_page(ledger: DataFrame, limit: int = 500, offset: int = 0) -> DataFrame:
    """IO6/O1: one page of the ledger, newest first (row_seq, account, file and hash break date ties)."""
    return _rows(ledger.orderBy(*newest_first(ledger)).offset(offset).limit(limit))


def month_filter(month: str):
    """P1 predicate. A full ``YYYY-MM`` compares the month column (partition pruning)."""
    if len(month) == 7:
        return F.col("month") == month
    return F.col("date").startswith(month)


def month_slice(ledger: DataFrame, month: str) -> DataFrame:
    """Rows whose date starts with ``month``, oldest first."""
    return _rows(ledger.where(month_filter(month)).orderBy("date", "row_seq", "account_id", "source_file", "hash"))


def uncategorized(ledger: DataFrame) -> DataFrame:
    """Rows without a category, newest first."""
    return _rows(ledger.where(F.col("category").isNull()).orderBy(*newest_first(ledger)))


def search(ledger: DataFrame, transaction_type: str | None = None, category: str | None = None,
           text: str | None = None, month: str | None = None) -> DataFrame:
    """Optional predicates ANDed, applied before any limit.

    ``category="_uncategorized"`` means null or empty; ``text`` is a
    case-insensitive substring of the raw description.
    """
    cond = search_condition(transaction_type, category, text, month)
    return _rows(ledger.where(cond).orderBy(*newest_first(ledger)))


def search_counts(ledger: DataFrame, by: Sequence[str] = (), **filters) -> DataFrame:
    """P3 info line + A18: rows the search shows and uncategorised rows, in one pass (no cap)."""
    return ledger.groupBy(*by).agg(
        F.count_if(search_condition(**filters)).cast("long").alias("shown"),
        F.count_if(F.coalesce(F.col("category"), F.lit("")) == "").cast("long").alias("uncategorized"),
    )


def search_condition(transaction_type=None, category=None, text=None, month=None):
    """P3 predicate: optional filters ANDed."""
    cond = F.lit(True)
    if transaction_type and transaction_type != "all":
        cond = cond & (F.col("transaction_type") == transaction_type)
    if category and category != "all":
        if category == "_uncategorized":
            cond = cond & (F.coalesce(F.col("category"), F.lit("")) == "")
        else:
            cond = cond & (F.col("category") == category)
    if text:
        cond = cond & F.lower(F.col("description")).contains(text.lower())
    if month:
        cond = cond & month_filter(month)
    return cond


def label_groups(ledger: DataFrame) -> DataFrame:
    """The label group of every stored row."""
    return ledger.select("account_id", "row_seq", "hash", stored_label_group().alias("label_group"))


def keyword_dimension(spark: SparkSession) -> DataFrame:
    """(priority, label_group, category, n_keywords) in match order (25 rows, fixed)."""
    rows = [(p, g, c, len(k)) for p, g, c, k in ordered_categories()]
    return spark.createDataFrame(rows, "priority int, label_group string, category string, n_keywords int")


def taxonomy_usage(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """P8 over data: every taxonomy category with its label group and how many
    ledger rows carry it (0 when unused). The 25-row dimension is broadcast."""
    dim = F.broadcast(keyword_dimension(ledger.sparkSession))
    used = ledger.where(F.col("category").isNotNull()).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_rows"))
    out = dim.join(used, on="category", how="left").select(
        "label_group", "category", "priority", "n_keywords",
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
    )
    return out.orderBy("priority")
