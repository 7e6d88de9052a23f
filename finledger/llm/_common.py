"""Helpers shared by the training-data operators.

* JVM-side word splitting (``[^\\x20\\x09-\\x0D]+``) and seeded uniform keys.
* :func:`written`: cut lineage with a Parquet table in the shared folder.
* :func:`ranked`: exact global ranks (and prefix sums) without a one-task
  window: rows are cut into about sqrt(n) buckets by a key that is uniform in
  [0, 1), windows run inside buckets, and bucket offsets are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finledger.session import fresh_dir, prepare_session

SPACES = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The same lower-casing for UTF-8 bytes inside Python tasks.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and kept when executors are lost."""
    spark = df.sparkSession
    path = fresh_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than the six ASCII spaces."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def text_tie(text: Column) -> Column:
    """Tie-break for rows of one id; equal texts stay tied (such rows are interchangeable)."""
    return F.xxhash64(text)


def id_key(col: Column) -> Column:
    """An id as a join key that also holds null ids."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def seal(df: DataFrame, **roles: str) -> DataFrame:
    """The columns that an operator works on, under its own names, and all of the input's as the struct ``_row``.

    So no column of the input can clash with a helper column. The text is not
    doubled: a role named ``_text`` stays out of ``_row``.
    """
    text = roles.get("_text")
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text]
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    return df.select(*[F.col(f"`{c}`").alias(r) for r, c in roles.items()], row.alias("_row"))


def unseal(df: DataFrame, like: DataFrame, text: str | None = None, now: str = "_text", added: Sequence[str] = ()) -> DataFrame:
    """The columns of ``like`` (its text from ``now``) and the added ones; an added name that is taken gets leading underscores."""
    cols = [F.col(now).alias(c) if c == text else F.col(f"_row.c{i}").alias(c) for i, c in enumerate(like.columns)]
    return df.select(*cols, *[F.col(a).alias(free_name(a, like.columns)) for a in added])


def free_name(name: str, taken: Sequence[str]) -> str:
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the columns alone (52 bits of an md5)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def with_uniform(rows: DataFrame, n: int, seed: int, keys: Sequence[str], row: str) -> DataFrame:
    """Adds ``_u``, :func:`uniform` of the keys, for :func:`ranked`.

    Rows of a key that more than about sqrt(n) rows share (a null id, one row repeated) get a number each, from ``row``,
    a column that tells them apart: else they would all fall into one bucket. There are at most sqrt(n) such keys.
    """
    key = F.xxhash64(*keys).alias("_key")
    hot = rows.select(key).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > buckets_for(n)).select(F.col("_key").alias("_hot"))
    d = rows.withColumn("_key", key).join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    spread = F.when(F.col("_hot").isNotNull(), uniform(seed, *[F.col(k) for k in keys], F.col(row)))
    return d.withColumn("_u", F.coalesce(spread, uniform(seed, *[F.col(k) for k in keys]))).drop("_key", "_hot")


def buckets_for(n: int) -> int:
    """About sqrt(n) buckets of about sqrt(n) rows: both stay small at any size."""
    return max(1, math.isqrt(max(0, n)))


def ranked(df: DataFrame, n: int, strata: Sequence[str], u: Column, order: Iterable[Column | str],
           out: str = "rank") -> DataFrame:
    """Adds ``out``: the 1-based rank of every row in its stratum.

    ``u`` is a monotone image of the order in [0, 1), about uniform, so no
    bucket of a hot stratum grows beyond a few times sqrt(n). Strata must not
    be null. ``df`` is read twice; pass a written table.
    """
    nb = buckets_for(n)
    cut = df.withColumn("_b", F.floor(u * F.lit(nb)).cast("long"))
    rows = cut.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy(*order)))
    sums = cut.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*strata, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = rows.join(sums, [*strata, "_b"], "left")
    return joined.withColumn(out, (F.col("_r") + F.col("_off")).cast("long")).drop("_b", "_r", "_off")


def in_pieces(items: Iterable, size, most: int):
    """Consecutive items in lists of at most ``most`` summed size (one item may exceed it): bounds a task's memory."""
    batch, total = [], 0
    for x in items:
        batch.append(x)
        total += size(x)
        if total >= most:
            yield batch
            batch, total = [], 0
    if batch:
        yield batch
