"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from finledger.functions.text import round_half_up
from finledger.session import fresh_dir


def debit() -> Column:
    return F.col("transaction_type") == "Debit"


def credit() -> Column:
    return F.col("transaction_type") == "Credit"


def money_sum(cond: Column | None = None, col: str = "amount") -> Column:
    """Exact decimal sum, optionally conditional (``SUM(CASE WHEN c THEN amount ELSE 0 END)``)."""
    x = F.col(col) if cond is None else F.when(cond, F.col(col)).otherwise(F.lit(0).cast("decimal(18,2)"))
    # (a pre-summed decimal column works too: the zero widens to its type)
    return F.sum(x)


def as_double(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double")


def r2(col: str | Column) -> Column:
    return round_half_up(col, 2)


def r1(col: str | Column) -> Column:
    return round_half_up(col, 1)


def mean_of(sum_col: Column, count_col: Column) -> Column:
    """Average as one IEEE division of an exact sum by a count."""
    return sum_col.cast("double") / count_col.cast("double")


def key_window(by: Sequence[str], *extra: str) -> Window:
    """Window over one ``by`` group (plus extra keys).

    With ``by=()`` and no extra keys this is a single global partition; it is
    only ever applied to small pre-aggregated inputs (months x categories).
    """
    keys = [*by, *extra]
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def present(df: DataFrame, by: Sequence[str], *order: Column | str) -> DataFrame:
    """Sort a report for display.

    A global report (``by=()``) is small and is sorted. A per-key report can be
    as large as the key space, so it is only sorted inside partitions; readers
    filter one key or write it out partitioned.
    """
    if not by:
        return df.orderBy(*order)
    return df.sortWithinPartitions(*by, *order)


def salted_join(left: DataFrame, small: DataFrame, on: Sequence[tuple[str, str]], spread_by: Sequence[str],
                how: str = "inner") -> DataFrame:
    """Equi-join with a small dimension on few, hot values (a category, or no value at all).

    The dimension is repeated once for each of ``spark.sql.shuffle.partitions`` salts
    and the left rows carry a salt of their ``spread_by`` columns, so neither a hot
    value nor a dimension of any size meets in one task, and nothing is broadcast by hint.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.hash(*spread_by), F.lit(n)) if spread_by else F.lit(0)
    many = F.sequence(F.lit(0), F.lit(n - 1)) if spread_by else F.array(F.lit(0))
    rows = left.withColumn("_salt", salt.cast("int"))
    dim = small.withColumn("_salt2", F.explode(many))
    cond = F.col("_salt") == F.col("_salt2")
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    return rows.join(dim, cond, how).drop("_salt", "_salt2", *[b for _, b in on])


def top_rows(df: DataFrame, k: int, order: list, by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows in ``order`` (globally, or per ``by`` key).

    Globally this plans a TakeOrderedAndProject (per-task top-k, then merge);
    per key a row_number over the key's rows, which are aggregates here.
    """
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def with_position(df: DataFrame, order: list, by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """The place of every row in the order of a report, from 1, as data.

    Per key it is a row number over the key's rows. Globally it is exact without a
    one-task sort: rows are dealt by ranges of the order and written, numbered inside their range,
    and moved on by the rows of the ranges before (a table of as many rows as ranges). ``order`` must be total.
    """
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    spark = df.sparkSession
    path = fresh_dir(spark, "positions")
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(path)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    rows = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    rows = rows.join(F.broadcast(sizes), F.col("_part") == F.col("_p"))
    return rows.select(*df.columns, (F.col("_before") + F.col("_rank")).cast("long").alias(name))
