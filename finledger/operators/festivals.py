"""Festival calendar and festive spending (A14, A15, A15b, R2, R3, R4, J3, J4, M3, IO10).

The festival table is a user-maintained dimension of any size. Every key is
paired with every active festival (that is the report) by a salted join;
everything else is aggregates and equi-joins on (key, calendar month). Keys come
from all ledger rows, so an account without debits has its festivals too.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finledger.functions.text import cal_month_of, filled
from finledger.operators._common import debit, mean_of, money_sum, present, r1, r2, salted_join, with_position
from finledger.taxonomy import CURRENCY_SYMBOL, DEFAULT_FESTIVALS, FESTIVAL_ALERT_DAYS, FESTIVAL_MESSAGES

FESTIVAL_SCHEMA = "festival_id long, name string, month int, day int, duration_days int, is_active int"
#: A calendar month read from two characters of a date lies between these, so that many months exist at most.
LEAST_CAL_MONTH, GREATEST_CAL_MONTH = -9, 99


def festivals_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Festival dimension; defaults to the configured calendar (IO10)."""
    rows = rows if rows is not None else [
        (i + 1, n, m, d, dur, 1) for i, (n, m, d, dur) in enumerate(DEFAULT_FESTIVALS)
    ]
    return spark.createDataFrame(rows, FESTIVAL_SCHEMA)


def seed_festivals(existing: DataFrame, defaults: DataFrame) -> DataFrame:
    """IO10 with decision D9: add only defaults whose (name, month, day) is new."""
    return defaults.join(existing.select("name", "month", "day"), on=["name", "month", "day"], how="left_anti")


def active_festivals(festivals: DataFrame) -> DataFrame:
    """M3: active festivals ordered by (month, day)."""
    return festivals.where(F.col("is_active") == 1).orderBy("month", "day", "festival_id")


def add_festival(festivals: DataFrame, name: str, month: int, day: int, duration_days: int = 1) -> DataFrame:
    """M3 add: append one active row (next id)."""
    spark = festivals.sparkSession
    next_id = festivals.agg(F.coalesce(F.max("festival_id"), F.lit(0)) + 1).first()[0]
    return festivals.unionByName(festivals_table(spark, [(next_id, name, month, day, duration_days, 1)]))


def remove_festival(festivals: DataFrame, festival_id: int) -> DataFrame:
    """M3 soft delete: ``is_active = 0`` for one id."""
    return festivals.withColumn(
        "is_active", F.when(F.col("festival_id") == festival_id, F.lit(0)).otherwise(F.col("is_active"))
    )


FESTIVAL_EVENT_SCHEMA = "name string, month int, day int, duration_days int, op string, event_time timestamp, event_seq long"


def current_festivals(events: DataFrame) -> DataFrame:
    """IO10/M3 as a change log: (name, month, day, duration_days, position) of the active festivals, by (month, day, name).

    Events are ``seed``, ``add`` and ``remove`` of a (name, month, day), in the order of (event_time, event_seq). The latest
    add or remove decides; a seed counts only where there is none, and the first seed stays: a restart neither revives what was removed
    nor changes what is there (decision D9). One aggregate with map-side combining, so a festival with very many events is no hot key.
    """
    at = F.struct("event_time", "event_seq")
    user = F.col("op") != "seed"
    state = events.groupBy("name", "month", "day").agg(
        F.max(F.when(user, F.struct("event_time", "event_seq", "op", "duration_days"))).alias("u"),
        F.min(F.when(~user, F.struct(at.alias("at"), F.col("duration_days")))).alias("s"))
    active = state.where(F.coalesce(F.col("u.op") == "add", F.col("s").isNotNull()))
    rows = active.select("name", "month", "day", F.when(F.col("u").isNotNull(), F.col("u.duration_days")).otherwise(F.col("s.duration_days")).alias("duration_days"))
    return with_position(rows, ["month", "day", "name"])


def _monthly_debits(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """Debit total of every (key, month) with any row; ``debits`` is 0 where it has none."""
    return (
        ledger.groupBy(*by, "month")
        .agg(money_sum(debit()).alias("total"), F.count_if(debit()).alias("debits"))
        .withColumn("cal_month", cal_month_of("month"))
    )


def festival_history(ledger: DataFrame, festivals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A14 + J3: per active festival, the average monthly debit total of its
    calendar month against the average over all months (festive included);
    extra = max(0, difference); suggested = extra x 1.1."""
    monthly = _monthly_debits(ledger, by)
    by_cal = monthly.groupBy(*by, "cal_month").agg(F.sum("total").alias("fm_sum"), F.count_if(F.col("debits") > 0).alias("fm_n"))
    # the overall average re-aggregates the (key, calendar month) rows: one pass over the ledger
    overall = by_cal.groupBy(*by).agg(F.sum("fm_sum").alias("all_sum"), F.sum("fm_n").alias("all_n"))
    active = festivals.where(F.col("is_active") == 1).select(
        "festival_id", "name", F.col("month").alias("fest_month"), F.col("day").alias("fest_day"), "duration_days")
    per_key = salted_join(overall, active, [], by)
    of_month = by_cal.select(*[F.col(k).alias(f"_{k}") for k in by], "cal_month", "fm_sum", "fm_n")
    cond = F.col("fest_month") == F.col("cal_month")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    j = per_key.join(of_month, cond, "left")
    fa = F.when(F.col("fm_n") > 0, mean_of(F.col("fm_sum"), F.col("fm_n"))).otherwise(F.lit(0.0))
    oa = F.when(F.col("all_n") > 0, mean_of(F.col("all_sum"), F.col("all_n"))).otherwise(F.lit(0.0))
    extra = F.greatest(F.lit(0.0), fa - oa)
    out = j.select(
        *by, "festival_id", "name", F.col("fest_month").alias("month"), F.col("fest_day").alias("day"),
        "duration_days",
        r2(fa).alias("avg_spend"), r2(oa).alias("normal_avg"), r2(extra).alias("extra_spend"),
        r2(extra * 1.1).alias("suggested_saving"),
    )
    return present(out, by, "month", "day", "festival_id")


def _alert_message(name: Column, days: Column, avg: Column, extra: Column, suggested: Column) -> Column:
    """When the festival is, and the history clause."""
    m, sym = FESTIVAL_MESSAGES, F.lit(CURRENCY_SYMBOL)
    head = (F.when(days == 0, filled(m["today"], name=name)).when(days == 1, filled(m["tomorrow"], name=name))
            .otherwise(filled(m["later"], name=name, days=days)))
    hist = filled(m["history"], symbol=sym, average=F.format_number(avg, 0))
    more = filled(m["extra"], symbol=sym, extra=F.format_number(extra, 0), suggested=F.format_number(suggested, 0))
    return F.when(avg > 0, F.concat(head, hist, F.when(extra > 0, more).otherwise(F.lit(".")))).otherwise(
        F.concat(head, F.lit(m["no_history"])))


def upcoming_festivals(ledger: DataFrame, festivals: DataFrame, as_of: dt.datetime,
                       days_ahead: int = FESTIVAL_ALERT_DAYS, mode: str = "date",
                       by: Sequence[str] = ()) -> DataFrame:
    """Festivals within ``days_ahead`` of ``as_of`` with history, message, urgency.

    mode="date": whole days; a festival today is 0 days away.
    mode="reference": midnight of the festival is compared with the as-of
    instant, so a festival today rolls to next year and days are floored.
    Dates that do not exist (29 Feb) are skipped.
    """
    hist = festival_history(ledger, festivals, by)
    year = as_of.year
    ts = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")  # session zone, not host zone
    today = F.lit(as_of.date())

    def mk(y):
        return F.try_to_date(
            F.format_string("%04d-%02d-%02d", F.lit(y), F.col("month"), F.col("day")), "yyyy-MM-dd")

    this_year, next_year = mk(year), mk(year + 1)
    if mode == "date":
        nxt = F.when(this_year < today, next_year).otherwise(this_year)
        days = F.datediff(nxt, today)
    elif mode == "reference":
        nxt = F.when(this_year.cast("timestamp") < ts, next_year).otherwise(this_year)
        secs = F.unix_timestamp(nxt.cast("timestamp")) - F.unix_timestamp(ts)
        days = F.floor(secs / 86400).cast("int")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    cand = hist.where(this_year.isNotNull()).select("*", nxt.alias("next_date"), days.alias("days_until"))
    cand = cand.where(F.col("next_date").isNotNull() & F.col("days_until").between(0, days_ahead))
    out = cand.select(
        *by, "festival_id", "name",
        F.date_format("next_date", "yyyy-MM-dd").alias("date"),
        F.col("days_until").cast("int").alias("days_until"),
        "duration_days",
        F.col("avg_spend").alias("historical_avg_spend"),
        "suggested_saving",
        _alert_message(F.col("name"), F.col("days_until"), F.col("avg_spend"), F.col("extra_spend"),
                       F.col("suggested_saving")).alias("message"),
        F.when(F.col("days_until") <= 7, "danger").when(F.col("days_until") <= 14, "warning")
        .otherwise("info").alias("urgency"),
        F.when(F.col("days_until") <= 7, "danger").otherwise("warning").alias("banner"),
    )
    return present(out, by, "days_until", "festival_id")


def festive_vs_normal(ledger: DataFrame, festivals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A15 + J4 + A15b: average monthly debit total in months whose calendar
    month holds an active festival vs the other months; keys without debit
    rows produce no row."""
    active = festivals.where((F.col("is_active") == 1) & F.col("month").between(LEAST_CAL_MONTH, GREATEST_CAL_MONTH))
    months = sorted(r.month for r in active.select("month").distinct().collect())  # no other month can match a date
    monthly = _monthly_debits(ledger, by).where(F.col("debits") > 0)
    festive = F.col("cal_month").isin(months) if months else F.lit(False)
    agg = monthly.groupBy(*by).agg(
        money_sum(festive, "total").alias("f_sum"), F.count_if(festive).alias("f_n"),
        money_sum(~festive, "total").alias("n_sum"), F.count_if(~festive).alias("n_n"),
    ).where(F.col("f_n") + F.col("n_n") > 0)
    fa = F.coalesce(mean_of(F.col("f_sum"), F.col("f_n")), F.lit(0.0))
    fa = F.when(F.col("f_n") > 0, fa).otherwise(F.lit(0.0))
    na = F.when(F.col("n_n") > 0, mean_of(F.col("n_sum"), F.col("n_n"))).otherwise(F.lit(0.0))
    diff = r2(fa - na)
    return agg.select(
        *by,
        r2(fa).alias("festive_months_avg"),
        r2(na).alias("normal_months_avg"),
        diff.alias("difference"),
        r1(F.when(na > 0, (fa - na) / na * 100).otherwise(F.lit(0.0))).alias("difference_pct"),
        F.col("f_n").cast("long").alias("festive_months_count"),
        F.col("n_n").cast("long").alias("normal_months_count"),
        r2(diff / 12).alias("monthly_set_aside"),
    )
