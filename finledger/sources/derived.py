"""Bank statements derived from the driver's tables.

The test data has no bank ledger, so statement rows are derived from
``orders`` (and, for volume, ``lineitem``): every order becomes one statement
line of one account (``o_custkey``). Dates come in the six accepted text
formats plus junk and times, narrations come from 26 templates, a few amounts are
unparsable, and every 50th line is re-sent once, so all the ingest traps are
exercised at any scale. Pure column expressions plus one generator: a single
scan, no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: narration templates (index, narration, is_credit) of the fixture.
TEMPLATES = [
    (0, "Zomato Order", 0), (1, "SWIGGY DELIVERY", 0), (2, "BIGBASKET", 0), (3, "UBER RIDE", 0),
    (4, "AMAZON PRIME", 0), (5, "NETFLIX SUBSCRIPTION", 0), (6, "Cesc Limited Bill", 0),
    (7, "HPCL PETROL", 0), (8, "APOLLO PHARMACY", 0), (9, "UDEMY COURSE", 0), (10, "HOUSE  RENT", 0),
    (11, "BOOKMYSHOW", 0), (12, "MAKEMYTRIP FLIGHT", 0), (13, "URBANCLAP SALON", 0),
    (14, "SIP MUTUAL FUND", 0), (15, "LIC PREMIUM", 0), (16, "CARD PAYMENT", 0), (17, "NEFT TRANSFER", 0),
    (18, "gym recurring fee", 0), (19, "RANDOM MERCHANT", 0), (20, "SALARY CREDIT", 1),
    (21, "RENT RECEIVED", 1), (22, "REFUND AMAZON", 1), (23, "INT PAID", 1), (24, "FREELANCE WORK", 1),
    (25, "MISC DEPOSIT", 1),
]
# Templates without a trailing reference number (they repeat as one description).
NO_REFERENCE = (5, 18)
MONTH_ABBR = "JanFebMarAprMayJunJulAugSepOctNovDec"
RESEND_EVERY = 50          # every 50th line appears twice
RESEND_OFFSET = 1_000_000_000
SEPARATOR_EVERY = 61       # narrations that hold the separator of the hash text
BAD_AMOUNT_EVERY = 97      # unparsable debit text, row dropped
TIMED_EVERY = 91           # dates with a time: no accepted format, but a month like any other


STATEMENT_COLUMNS = ["account_id", "source_file", "row_seq", "date_text", "narration", "debit_text", "credit_text"]


def _date_text(seq: Column, iso: Column) -> Column:
    day, mon, year = F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4)
    abbr = F.substring(F.lit(MONTH_ABBR), (mon.cast("int") - 1) * 3 + 1, 3)
    k = seq % 7
    return (
        F.when(seq % TIMED_EVERY == 0, F.concat(iso, F.lit(" 10:00:00")))
        .when(k == 0, iso)
        .when(k == 1, F.concat_ws("-", day, mon, year))
        .when(k == 2, F.concat_ws("/", day, mon, year))
        .when(k == 3, F.concat_ws("/", mon, day, year))
        .when(k == 4, F.concat_ws("/", year, mon, day))
        .when(k == 5, F.concat_ws("-", day, abbr, year))
        .when(seq % 196 == 6, F.lit(" "))                                   # blank
        .when(seq % 14 == 6, F.lit("bad date"))
        .when(seq % 28 == 13, F.concat(F.lit("\t"), iso, F.lit(" \t")))    # padded with other spaces than blanks
        # no accepted format, but a calendar month of one digit can be read
        .otherwise(F.concat(year, F.lit("/"), mon.cast("int").cast("string"), F.lit("/?"), day))
    )


def derive_statements(rows: DataFrame, account: Column, seq: Column, idx: Column,
                      day: Column, price: Column) -> DataFrame:
    """Statement lines (all text, like a CSV) from any keyed, dated, priced table."""
    narrations = F.array(*[F.lit(n) for _, n, _ in TEMPLATES])
    credit_flags = F.array(*[F.lit(c) for _, _, c in TEMPLATES])
    base = rows.select(
        account.alias("account_id"),
        seq.alias("seq0"),
        idx.cast("int").alias("idx"),
        day.cast("date").cast("string").alias("iso"),
        price.cast("decimal(18,2)").cast("string").alias("amt"),
    )
    s = F.col("seq0")
    tmpl = F.element_at(narrations, F.col("idx") + 1)
    is_credit = F.element_at(credit_flags, F.col("idx") + 1) == 1
    lines = base.select(
        "account_id",
        F.lit(None).cast("string").alias("source_file"),
        s.alias("seq0"),
        _date_text(s, F.col("iso")).alias("date_text"),
        F.when(F.col("idx").isin(*NO_REFERENCE), tmpl)
        .otherwise(F.concat(tmpl, F.lit("-"), F.lpad(s.cast("string"), 8, "0"),
                            F.when(s % SEPARATOR_EVERY == 0, F.lit("|500.0")).otherwise(F.lit("")))).alias("narration"),
        F.when(s % BAD_AMOUNT_EVERY == 0, F.lit("abc"))
        .when(is_credit, F.lit("0")).otherwise(F.col("amt")).alias("debit_text"),
        F.when(is_credit & (s % BAD_AMOUNT_EVERY != 0), F.col("amt")).otherwise(F.lit("0")).alias("credit_text"),
        # one copy, or two for re-sent lines: a generator instead of a second scan
        F.explode(F.sequence(F.lit(0), F.when(s % RESEND_EVERY == 0, 1).otherwise(0))).alias("copy"),
    )
    return lines.select(
        "account_id", "source_file",
        (F.col("seq0") + F.col("copy") * F.lit(RESEND_OFFSET)).alias("row_seq"),
        "date_text", "narration", "debit_text", "credit_text",
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over ``spark.sql.shuffle.partitions`` tasks for the CPU-heavy per-line work.

    The test tables are files of one row group, which would be parsed in one
    task. The rule is the same at every size; real statements come from files
    and are not dealt.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def orders_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement lines of every order: account = customer, sequence = order key."""
    o = spread(read_table(spark, sf_dir, "orders"), "o_orderkey")
    return derive_statements(
        o,
        account=F.col("o_custkey"),
        seq=F.col("o_orderkey"),
        idx=F.col("o_orderkey") % 26,
        day=F.col("o_orderdate"),
        price=F.col("o_totalprice"),
    )


def lineitem_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume variant: one statement line per line item, account = supplier."""
    li = spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey")
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return derive_statements(
        li,
        account=F.col("l_suppkey"),
        seq=seq,
        idx=(F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 26,
        day=F.col("l_shipdate"),
        price=F.col("l_extendedprice"),
    )
