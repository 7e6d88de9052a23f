"""Structured Streaming: incremental ingest and live totals (ST1, ST2, ST3).

ST1  arriving statement files -> classified lines -> first copies not yet
     stored -> one committed batch per micro-batch. The writer is named in the
     checkpoint and the keys of every other batch are looked up, so a replayed batch gives exactly the same
     rows and takes the place of its first version: the sink is idempotent and the checkpoint makes it exactly-once.
ST2  bounded-lateness de-duplication with ``dropDuplicatesWithinWatermark``.
ST3  daily debit totals per (key, day) of a stored ledger: its manifest is the change feed, every
     new version gets partial sums, readers add up those of the live versions. Statements of any
     age count (there is no watermark on the date of a transaction); a replayed
     batch replaces its own partials, and no state is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finledger.operators.ingest import ACCOUNT_KEY, prepare_transactions
from finledger.sources import manifest, store

STATEMENT_CSV_SCHEMA = "Date string, Narration string, `Debit Amount` string, `Credit Amount` string"


def ledger_sink(ledger_path: str, writer: str, models=None, key: Sequence[str] = ACCOUNT_KEY) -> Callable[[DataFrame, int], None]:
    """ST1 foreachBatch body: classify, keep first copies not yet stored, write batch folder."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # a stream cannot number rows; inside the micro-batch each file is one
        # split (multiLine), so the id keeps the line order within a file
        lines = batch.withColumn("row_seq", F.coalesce(F.col("row_seq"), F.monotonically_increasing_id()))
        store.append_new(batch.sparkSession, prepare_transactions(lines, models), ledger_path, batch_id, key, writer)

    return write_batch


def start_ingest(lines: DataFrame, ledger_path: str, checkpoint: str, models=None,
                 available_now: bool = True, processing_time: str | None = None):
    """ST1: run the incremental ingest of a streaming DataFrame of statement lines."""
    writer = store.stream_writer(lines.sparkSession, checkpoint)
    w = lines.writeStream.foreachBatch(ledger_sink(ledger_path, writer, models)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "30 seconds")
    return w.start()


def statement_csv_stream(spark: SparkSession, directory: str, account_id=None, account_column: str | None = None) -> DataFrame:
    """Arriving statement CSVs as statement lines. An explicit schema with
    ``enforceSchema=false`` fails fast on a file whose header differs.
    ``account_column`` names a leading column with the account of each line."""
    schema = STATEMENT_CSV_SCHEMA if account_column is None else f"`{account_column}` string, {STATEMENT_CSV_SCHEMA}"
    raw = (
        spark.readStream.schema(schema)
        .options(header="true", enforceSchema="false", multiLine="true", escape='"')
        .csv(directory)
    )
    return raw.select(
        (F.lit(account_id) if account_column is None else F.col(f"`{account_column}`")).cast("long").alias("account_id"),
        F.col("_metadata.file_path").alias("source_file"),
        F.lit(None).cast("long").alias("row_seq"),       # numbered per micro-batch by the sink
        F.col("Date").alias("date_text"), F.col("Narration").alias("narration"),
        F.col("`Debit Amount`").alias("debit_text"), F.col("`Credit Amount`").alias("credit_text"),
    )


def dedupe_within_watermark(tx: DataFrame, delay: str = "1 hour", key: Sequence[str] = ACCOUNT_KEY) -> DataFrame:
    """ST2: drop re-sent copies arriving within ``delay`` of each other (arrival time)."""
    return (
        tx.withColumn("arrived_at", F.current_timestamp())
        .withWatermark("arrived_at", delay)
        .dropDuplicatesWithinWatermark([*key, "hash"])
    )


def daily_partials(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ST3: debit total per (key, day) of some ledger rows, for each batch they came in."""
    d = rows.where((F.col("transaction_type") == "Debit") & F.col("txn_date").isNotNull())
    return d.groupBy("writer", "batch", *by, F.col("txn_date").alias("day")).agg(F.sum("amount").cast("decimal(28,2)").alias("total"))


def update_daily(spark: SparkSession, ledger_path: str, path: str, by: Sequence[str] = ()) -> None:
    """Bring the partial sums under ``path`` to the ledger's present state.

    Versions that have no partials yet get them, each in a folder of its own (overwritten if an earlier try left one);
    then a commit in ``path``'s own manifest makes the ledger's live versions the ones that are summed. So a
    replayed batch takes the place of its older rows, and a compaction that of the batches it merged.
    """
    now, mine = manifest.state(spark, ledger_path), manifest.state(spark, path)
    have = {v.name for v in mine.live}
    for v in now.live:
        if v.name not in have:
            rows = store.read_versions(spark, ledger_path, [replace(v, gone=())])
            daily_partials(rows, by).write.mode("overwrite").parquet(f"{path.rstrip('/')}/partials/version={v.name}")
    if now.live != mine.live:
        manifest.commit(spark, path, mine, list(now.live), kind="daily", ledger_seq=now.seq)


def start_daily_totals(spark: SparkSession, ledger_path: str, path: str, checkpoint: str, by: Sequence[str] = (), available_now: bool = True,
                       processing_time: str | None = None):
    """ST3: keep daily totals of a stored ledger under ``path`` (one checkpoint for each path).

    The stream is the ledger's manifest: a commit wakes it, and :func:`update_daily` does the work.
    """
    fs, folder = manifest.files(spark, manifest.folder(ledger_path))
    fs.mkdirs(folder)
    commits = spark.readStream.schema("seq long").json(manifest.folder(ledger_path))
    w = commits.writeStream.foreachBatch(lambda batch, _: update_daily(spark, ledger_path, path, by)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "30 seconds")
    return w.start()


def daily_totals(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """ST3 read back: partial sums of all live batches added up."""
    types = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(store.LEDGER_SCHEMA)}
    schema = ", ".join(["writer string", "batch long", *[f"{c} {types[c]}" for c in by], "day date", "total decimal(28,2)"])
    live = list(manifest.state(spark, path).live)
    return store.scan(spark, path, "partials", live, schema).groupBy(*by, "day").agg(F.sum("total").alias("total"))


def month_rollup(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ST3 month view: Spark windows have no calendar month, so roll days up."""
    return daily.groupBy(*by, F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("total").alias("total"))
