"""Bank-statement CSV scan (IO1, IO11) and CSV export (IO7).

Columns bind by header *name*, and any number of files with any header
layouts is one distributed scan: Spark lists the files (nested folders too),
every file is read without a header as text cells, and the map from a file's
header to the statement columns is a small table, written by one job before and joined by file. No
file is opened on the driver. Numbers and dates are parsed by expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finledger.operators.ledger import newest_first
from finledger.session import fresh_dir, written
from finledger.sources.derived import STATEMENT_COLUMNS
from finledger.taxonomy import REQUIRED_CSV_COLUMNS

_CANONICAL = {
    "Date": "date_text",
    "Narration": "narration",
    "Debit Amount": "debit_text",
    "Credit Amount": "credit_text",
}


def _headers(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, int]:
    """(file, header): the trimmed column names of each file's first line, and the most columns of any.

    One job reads the lines and writes this table. A header holds every required name, so all other lines of a file are one group of a
    hash aggregate, and no text but that of lines like headers is compared or shuffled.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(paths)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                         F.monotonically_increasing_id().alias("id")).where("at = 0")
    like = F.lit(True)
    for name in REQUIRED_CSV_COLUMNS:
        like = like & F.col("value").contains(name)
    seen = lines.groupBy("file", F.when(like, F.col("value")).alias("line")).agg(F.min("id").alias("id"))
    path = fresh_dir(spark, "csv-headers")
    seen.groupBy("file").agg(F.min_by("line", "id").alias("line"), F.min("id").alias("id")).write.parquet(path)
    first = spark.read.schema("file string, line string").parquet(path)
    # enough cells for every header; a comma inside quotes only makes it more
    sizes = first.agg(F.max(F.size(F.split("line", ","))), F.min(F.when(F.col("line").isNull(), F.col("file"))), F.count(F.lit(1))).first()
    most, bad = sizes[0], sizes[1]
    if not sizes[2]:
        raise ValueError(f"no statement files under {paths}")
    if bad is not None:
        line = lines.where(F.col("file") == bad).orderBy("id").first().value
        check_columns([c.strip() for c in line.removeprefix("\ufeff").split(",")])
    cells = F.from_csv(F.regexp_replace("line", "^\ufeff", ""), _cells(most), {"escape": '"'})
    names = F.transform(F.array(*[cells[f"_c{i}"] for i in range(most)]), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    return first.select("file", names.alias("header")), most


def _cells(n: int) -> str:
    return ", ".join(f"_c{i} string" for i in range(n))


def check_columns(columns: list[str]) -> None:
    missing = [c for c in REQUIRED_CSV_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"CSV missing required columns: {missing}")


def read_statement_csv(spark: SparkSession, paths: str | list[str], account_id=None,
                       account_column: str | None = None, multi_line: bool = True,
                       strip_thousands: bool = False) -> DataFrame:
    """IO1 + IO11: statement lines from one or many CSV files, as strings.

    Output columns match the derived statements: account_id, source_file,
    row_seq, date_text, narration, debit_text, credit_text. ``row_seq`` keeps
    the order within a file. ``account_column`` names an optional CSV column
    holding the account of each line (multi-account exports); otherwise
    ``account_id`` applies to all. ``multi_line`` allows line breaks inside
    quotes and makes each file one task; set it to False for large files
    without them, which are then split. ``strip_thousands`` removes commas from
    amounts (decision D4). A repeated header line is a header, not a transaction.
    """
    if isinstance(paths, str):
        paths = [paths]
    headers, most = _headers(spark, paths)
    short = headers.where(~F.forall(F.lit(REQUIRED_CSV_COLUMNS), lambda c: F.array_contains("header", c))).limit(1).collect()
    if short:
        check_columns(short[0].header)
    raw = (spark.read.schema(_cells(most)).options(
        header="false", multiLine=str(multi_line).lower(), escape='"', mode="PERMISSIVE", recursiveFileLookup="true").csv(paths))
    raw = raw.select(F.array(*[F.col(f"_c{i}") for i in range(most)]).alias("cells"), F.col("_metadata.file_path").alias("source_file"),
                     F.monotonically_increasing_id().alias("row_seq"))
    j = raw.join(headers, F.col("source_file") == F.col("file"))

    def cell(name: str):
        return F.get("cells", F.array_position("header", F.lit(name)).cast("int") - 1)  # the first of two equal names

    is_header = F.lit(True)
    for name in _CANONICAL:
        is_header = is_header & F.coalesce(F.trim(cell(name)) == name, F.lit(False))
    j = j.where(~is_header)
    if account_column is not None:
        account = F.coalesce(cell(account_column), F.lit(account_id).cast("string"))
    else:
        account = F.lit(account_id)

    def value(name: str):
        return F.replace(cell(name), F.lit(","), F.lit("")) if strip_thousands and name.endswith("Amount") else cell(name)

    return j.select(account.cast("long").alias("account_id"), "source_file", "row_seq",
                    *[value(src).alias(dst) for src, dst in _CANONICAL.items()]).select(*STATEMENT_COLUMNS)


def export_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """IO7: header CSV, newest first; ``limit`` is optional (the UI capped at 10,000)."""
    out = df.orderBy(*newest_first(df))
    if limit is not None:
        out = out.limit(limit)
    out.write.mode("overwrite").option("header", True).csv(path)


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of an export with their ``position`` in it, from 1.

    A split of a file is read by one task in one go, so a line's place in its split is its id less the split's first id, and only the
    sizes of the splits are put in order. The lines are neither sorted nor dealt again; they are written with their ids
    first, since a second scan may be split otherwise.
    """
    split = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    lines = written(spark.read.csv(path, header=True, escape='"', schema=schema).withColumns(split), "export-lines")
    splits = lines.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = splits.select("_file", "_start", (before - F.col("_first") + 1).alias("_shift"))
    return lines.join(F.broadcast(firsts), ["_file", "_start"]).withColumn("position", (F.col("_at") + F.col("_shift")).cast("long")).drop(*split, "_shift")
