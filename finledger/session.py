"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "finledger") -> SparkSession:
    """Session used by tests and the bench. Production jobs get theirs from the cluster."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FINLEDGER_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare_session(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on (idempotent, no restart needed).

    * UTC session zone: Parquet timestamps are ``timestamp_ntz``; casts to
      ``timestamp`` for event-time windows must not depend on the host zone.
    * CORRECTED datetime parsing: unparsable dates become null, never an error.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.legacy.timeParserPolicy", "CORRECTED")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session. Only a ``local`` master, where driver
    and executors are one machine, may leave it unset: then a scratch folder is
    chosen and recorded in the session, so every later call (and
    ``DataFrame.checkpoint``) uses the same root. On a cluster an unset folder
    is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="finledger-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    root = root.rstrip("/")
    return "/".join([root, *parts]) if parts else root


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared checkpoint root."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, however many jobs read it, and kept when executors are lost."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
