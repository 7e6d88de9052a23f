"""Ledger storage (IO3 append, IO4 training bag, IO8 snapshot, M5 uniqueness).

Three folders under the ledger's path:

* ``rows/version=<v>/month=<yyyy-mm>/``: the transactions of one batch, or of many after a compaction;
* ``keys/version=<v>/bucket=<b>/``: the key index, (account, hash) of the same rows. The bucket is a hash of the month text at the
  head of the hashed text, so equal keys share a bucket whatever their date looks like, and a batch looks up only the
  buckets of its own months, of two narrow columns;
* ``manifest/``: the commit log (:mod:`finledger.sources.manifest`). Rows count from the moment their version is committed.

Every upload is a writer of its own; a stream is one writer, named once in its checkpoint, with a batch for each
micro-batch. A batch is checked against all other batches (of its own writer: the earlier ones), so a replayed batch
gives the same rows again, as a new version that replaces its older one. Two uploads at the same moment cannot both commit from the
same state: the later one looks its keys up again. Paths are given by the caller or lie under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finledger.functions.text import month_of
from finledger.operators.ingest import ACCOUNT_KEY, LEDGER_COLUMNS, new_rows, training_rows
from finledger.sources import manifest
from finledger.sources.manifest import State, Version

LEDGER_SCHEMA = (
    "account_id long, source_file string, row_seq long, date string, month string, txn_date date, "
    "description string, processed string, amount decimal(18,2), transaction_type string, "
    "category string, is_saving int, hash string, uploaded_at timestamp, writer string, batch long"
)
_KEY_SCHEMA = "account_id long, hash binary, writer string, batch long, bucket int"
#: Month folder of rows with a blank date (an empty folder name would read back as null); longer than any month text.
NO_MONTH = "no-month"
KEY_BUCKETS = 64
_ATTEMPTS = 20
#: Versions of fewer rows are merged by a compaction.
SMALL_ROWS = 10_000_000


def exists(spark: SparkSession, path: str) -> bool:
    fs, hp = manifest.files(spark, path)
    return fs.exists(hp)


def new_writer() -> str:
    """Name of a one-off upload."""
    return f"upload-{uuid.uuid4().hex[:12]}"


def stream_writer(spark: SparkSession, checkpoint: str) -> str:
    """The writer of a stream: made once and kept in its checkpoint, so a restart
    keeps its name and a new checkpoint gets a new one."""
    path = f"{checkpoint.rstrip('/')}/_ledger_writer"
    if not exists(spark, path):
        spark.createDataFrame([(f"stream-{uuid.uuid4().hex[:12]}",)], "writer string").coalesce(1).write.parquet(path)
    return spark.read.schema("writer string").parquet(path).first().writer


# ---------------------------------------------------------------- versions


def key_bucket() -> Column:
    """The index bucket of a row: the month text up to the first separator of the hashed text, so it follows from the hash."""
    head = F.substring_index(F.coalesce("date", F.lit("")), "|", 1)
    return F.pmod(F.xxhash64(month_of(head)), F.lit(KEY_BUCKETS)).cast("int")


def _spread_write(df: DataFrame, column: str, path: str) -> None:
    """One folder for each value. ``rebalance`` spreads the write tasks by it, and AQE still
    splits a value that a third of all rows have over many tasks instead of one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.hint("rebalance", n, column).write.mode("overwrite").partitionBy(column).parquet(path)


def _write_version(spark: SparkSession, rows: DataFrame, path: str, batches: tuple) -> Version:
    """Rows (with uploaded_at, writer and batch) and their keys as a version that nobody reads before it is committed."""
    name = uuid.uuid4().hex[:16]
    month = F.when(F.col("month") == "", F.lit(NO_MONTH)).otherwise(F.col("month"))
    _spread_write(rows.withColumn("month", month), "month", f"{path}/rows/version={name}")
    stored = scan(spark, path, "rows", [Version(name)], LEDGER_SCHEMA)
    keys = stored.select("account_id", F.unhex("hash").alias("hash"), "writer", "batch", key_bucket().alias("bucket"))
    _spread_write(keys, "bucket", f"{path}/keys/version={name}")
    return Version(name, batches, stored.count())


def scan(spark: SparkSession, path: str, kind: str, versions: list[Version], schema: str) -> DataFrame:
    """The rows of some versions, without those that newer versions hold."""
    fields = StructType.fromDDL(schema)
    if not versions:
        return spark.createDataFrame([], fields)
    root = f"{path.rstrip('/')}/{kind}"
    df = spark.read.schema(f"{schema}, version string").option("basePath", root).parquet(*[f"{root}/version={v.name}" for v in versions])
    for v in versions:
        for writer, batch in v.gone:
            df = df.where(~((F.col("version") == v.name) & (F.col("writer") == writer) & (F.col("batch") == batch)))
    return df.select(*fields.names)


def _displayed(stored: DataFrame) -> DataFrame:
    """Rows as they were ingested. The folder of blank dates is a branch of its own, so a
    filter on ``month`` stays a filter on the partition column (and leaves that branch out)."""
    blank = stored.where(F.col("month") == NO_MONTH).withColumn("month", F.lit(""))
    return stored.where(F.col("month").isNull() | (F.col("month") != NO_MONTH)).unionByName(blank.select(stored.columns))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored ledger for queries; None before the first commit."""
    now = manifest.state(spark, path)
    return _displayed(scan(spark, path, "rows", list(now.live), LEDGER_SCHEMA)) if now.seq else None


def read_versions(spark: SparkSession, path: str, versions: list[Version]) -> DataFrame:
    return _displayed(scan(spark, path, "rows", versions, LEDGER_SCHEMA))


def known_keys(spark: SparkSession, path: str, tx: DataFrame, now: State | None = None, writer: str | None = None,
               before_batch: int | None = None) -> DataFrame | None:
    """(account_id, hash) of the stored rows that can equal a row of ``tx``: the index buckets of its months (at most
    ``KEY_BUCKETS`` numbers reach the driver). With ``writer`` and ``before_batch`` without that writer's batches from there on."""
    now = now or manifest.state(spark, path)
    if not now.live:
        return None
    touched = [r[0] for r in tx.select(key_bucket()).distinct().collect()]
    keys = scan(spark, path, "keys", list(now.live), _KEY_SCHEMA).where(F.col("bucket").isin(touched))
    if before_batch is not None:
        keys = keys.where((F.col("writer") != writer) | (F.col("batch") < before_batch))
    return keys.select("account_id", F.lower(F.hex("hash")).alias("hash"))


# ---------------------------------------------------------------- writing


def _stamped(rows: DataFrame, writer: str, batch_id: int) -> DataFrame:
    return rows.select(*LEDGER_COLUMNS, F.current_timestamp().alias("uploaded_at"), F.lit(writer).alias("writer"), F.lit(batch_id).cast("long").alias("batch"))


def _commit_batch(spark, rows: DataFrame, path: str, now: State, writer: str, batch_id: int) -> Version | None:
    version = _write_version(spark, _stamped(rows, writer, batch_id), path, ((writer, batch_id, batch_id),))
    live = manifest.after_batch(now, version, writer, batch_id)
    done = manifest.commit(spark, path, now, live, kind="batch", writer=writer, batch=batch_id, version=version.name)
    return version if done else None


def write_batch(rows: DataFrame, path: str, batch_id: int = 0, writer: str | None = None) -> None:
    """Store de-duplicated rows as one batch, without a look at what is stored."""
    spark, writer = rows.sparkSession, writer or new_writer()
    path = path.rstrip("/")
    version = _write_version(spark, _stamped(rows, writer, batch_id), path, ((writer, batch_id, batch_id),))
    for _ in range(_ATTEMPTS):
        now = manifest.state(spark, path)
        live = manifest.after_batch(now, version, writer, batch_id)
        if manifest.commit(spark, path, now, live, kind="batch", writer=writer, batch=batch_id, version=version.name):
            return
    raise RuntimeError(f"other writers kept committing to {path}")


def append_new(spark: SparkSession, transactions: DataFrame, path: str, batch_id: int = 0,
               key=ACCOUNT_KEY, writer: str | None = None, cache: bool = True) -> DataFrame:
    """IO3: store the first copies of transactions whose (key, hash) is not stored yet.

    ``key`` is ``("account_id",)``, or empty for one ledger without accounts. Without ``writer`` the call is an upload of its own.
    ``cache=False``: the transactions, which are read twice, are a stored table and need no copy in memory. Returns
    the rows of this batch as written (read back from storage).
    """
    if not set(key) <= {"account_id"}:
        raise ValueError(f"the index holds account_id and hash, not {key}")
    writer, path, tx = writer or new_writer(), path.rstrip("/"), None
    try:
        for _ in range(_ATTEMPTS):
            now = manifest.state(spark, path)
            if not now.live:
                rows = new_rows(transactions, None, key)
            else:
                if cache and tx is None:
                    tx = transactions.persist()
                rows = new_rows(transactions, known_keys(spark, path, transactions, now, writer, batch_id), key)
            version = _commit_batch(spark, rows, path, now, writer, batch_id)
            if version is not None:
                return read_versions(spark, path, [version])
    finally:
        if tx is not None:
            tx.unpersist()
    raise RuntimeError(f"other writers kept committing to {path}")


def compact(spark: SparkSession, path: str, small_rows: int = SMALL_ROWS) -> Version | None:
    """Merge the versions of fewer than ``small_rows`` rows (and those with replaced batches) into one: a file or a few for each month
    instead of one for each batch and month. Readers switch to it through the manifest; rows keep their
    writer and batch, so replays stay exact. None if there is nothing to merge, or another commit came first (nothing changes then)."""
    path = path.rstrip("/")
    now = manifest.state(spark, path)
    old = [v for v in now.live if v.rows < small_rows or v.gone]
    if len(old) < 2:
        return None
    batches = manifest.ranges(old)
    gone = tuple(sorted({g for v in old for g in v.gone if not any(o.holds(*g) for o in old)}))
    version = _write_version(spark, _displayed(scan(spark, path, "rows", old, LEDGER_SCHEMA)), path, batches)
    version = Version(version.name, version.batches, version.rows, gone)
    live = [*[v for v in now.live if v not in old], version]
    done = manifest.commit(spark, path, now, live, kind="compaction", version=version.name, merged=[v.name for v in old])
    return version if done else None


def vacuum(spark: SparkSession, path: str, older_than_hours: float = 24.0) -> int:
    """Delete version folders that no reader needs: not live, and untouched for so long that no batch can still be writing them."""
    path, live, n = path.rstrip("/"), {v.name for v in manifest.state(spark, path).live}, 0
    limit = (dt.datetime.now().timestamp() - 3600 * older_than_hours) * 1000
    for kind in ("rows", "keys"):
        fs, hp = manifest.files(spark, f"{path}/{kind}")
        for status in fs.listStatus(hp) if fs.exists(hp) else []:
            name = status.getPath().getName()
            if name.startswith("version=") and name[8:] not in live and status.getModificationTime() < limit:
                fs.delete(status.getPath(), True)
                n += 1
    return n


def append_training(inserted: DataFrame, path: str, batch_id: int = 0, writer: str | None = None) -> None:
    """IO4: one (processed text, category) per categorised inserted row, in a folder of its own
    batch: a replayed batch rewrites its examples."""
    training_rows(inserted).write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/writer={writer or new_writer()}/batch={batch_id}")


def snapshot(tables: dict[str, DataFrame], root: str, at: dt.datetime | None = None) -> str:
    """IO8: write every table under ``root/backup_<YYYYmmdd_HHMMSS>/<table>``."""
    at = at or dt.datetime.now()
    folder = f"{root.rstrip('/')}/backup_{at.strftime('%Y%m%d_%H%M%S')}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder
