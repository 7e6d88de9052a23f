"""Registered queries: text models, streaming ingest and the CSV source.

Streaming queries run with ``trigger(availableNow=True)`` into folders under
the shared checkpoint root and return what they wrote, read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from finledger.functions.text import round_half_up
from finledger.operators import corrections, ingest, ml
from finledger.plans import oracle as O
from finledger.plans.catalog import AS_OF_MONTH, LEDGER_SELECT, ledger_of, register, statements
from finledger.plans.fixtures import CORRECTION_RULES
from finledger.plans.more_queries import _corrections_sql
from finledger.session import fresh_dir, prepare_session, written
from finledger.sources.csv import export_csv, read_export, read_statement_csv
from finledger.sources.derived import derive_statements, spread
from finledger.sources import store
from finledger.sources.store import append_new, read_ledger, snapshot
from finledger.streaming import ingest_stream as st
from finledger.taxonomy import CONFIDENCE_THRESHOLD, EXPENSE, SAVINGS

SPLIT_DATE = "1998-01-01"   # statements are uploaded in two periods

# ---------------------------------------------------------------- ML0-ML6, IO9

_BAG_CTE = _corrections_sql() + """, bag AS (
  SELECT processed AS description, category FROM ledger WHERE category IS NOT NULL UNION ALL
  SELECT l.processed, c.new_category FROM corr c JOIN ledger l ON l.account_id = c.account_id AND l.hash = c.hash)"""


def _bag(spark, sf_dir):
    """The ledger (what the models and their scores need of it) and its training bag, each computed once and stored."""
    led = written(ledger_of(spark, sf_dir).select("account_id", "row_seq", "hash", "processed", "transaction_type", "category"), "ml-ledger")
    return led, written(corrections.training_bag(led, corrections.rule_corrections(led, CORRECTION_RULES)), "ml-bag")


@register("ml_features", O.over_ledger(
    "SELECT description, term, CAST(floor(x / sqrt(sum(x * x) OVER (PARTITION BY description)) * 1000000 + 0.5) / 1000000 AS DOUBLE) AS weight FROM ("
    "SELECT t.description, t.term, count(*) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS x "
    "FROM term t JOIN freq USING (term), (SELECT count(*) AS n FROM bag) GROUP BY t.description, t.term, df, n)",
    _BAG_CTE + r""", doc AS (SELECT description, count(*) AS copies, regexp_extract_all(lower(description), '[\p{L}\p{M}\p{N}_]{2,}') AS tok FROM bag GROUP BY description),
term AS (SELECT description, copies, unnest(tok) AS term FROM doc UNION ALL
  SELECT description, copies, tok[i] || ' ' || tok[i + 1] FROM (SELECT *, unnest(range(1, len(tok))) AS i FROM doc)),
freq AS (SELECT term, sum(copies) AS df FROM (SELECT DISTINCT description, copies, term FROM term) GROUP BY term)"""))
def q_ml_features(spark, sf_dir):
    """ML0: the TF-IDF rows of every distinct text of the training bag."""
    wbag = corrections.weighted_bag(_bag(spark, sf_dir)[1])
    texts = wbag.select(F.col("description").alias("text")).distinct()
    f = ml.features(texts, ml.term_table(wbag))
    return f.select(F.col("text").alias("description"), "term", round_half_up("weight", 6).alias("weight"))


def _class_sql() -> str:
    label = {"debit_type": f"CASE WHEN s THEN {O._q(SAVINGS)} ELSE {O._q(EXPENSE)} END",
             "expense": "CASE WHEN s THEN 'Other' ELSE category END", "savings": "CASE WHEN s THEN category ELSE 'Other' END"}
    parts = [f"SELECT '{m}' AS model, {x} AS label FROM b" for m, x in label.items()]
    return ("SELECT model, label, CAST(row_number() OVER (PARTITION BY model ORDER BY label) - 1 AS INT) AS idx, weight FROM ("
            f"SELECT model, label, CAST(count(*) AS DOUBLE) AS weight FROM ({' UNION ALL '.join(parts)}) GROUP BY model, label)")


@register("ml_classes", O.over_ledger(_class_sql(), _BAG_CTE + f", b AS (SELECT category, category IN {O.SAVINGS_IN} AS s FROM bag)"))
def q_ml_classes(spark, sf_dir):
    """ML1-ML3: the classes of each model with their training examples."""
    return ml.class_counts(_bag(spark, sf_dir)[1])


_FP = "CAST(sum(CAST('0x' || substr(md5(description || '|' || category), 1, 15) AS BIGINT)) AS VARCHAR)"


@register("model_registry", O.over_ledger(
    f"SELECT 'corrected' AS step, count(*) AS n, {_FP} AS h, count(DISTINCT category) FILTER (category NOT IN {O.SAVINGS_IN}) + 1 AS expense_classes, false AS reused FROM bag "
    f"UNION ALL SELECT 'as ingested', count(*), {_FP}, count(DISTINCT category) FILTER (category NOT IN {O.SAVINGS_IN}) + 1, false FROM kept "
    f"UNION ALL SELECT 'corrected again', count(*), {_FP}, count(DISTINCT category) FILTER (category NOT IN {O.SAVINGS_IN}) + 1, true FROM bag",
    _BAG_CTE + ", kept AS (SELECT processed AS description, category FROM ledger WHERE category IS NOT NULL)"))
def q_model_registry(spark, sf_dir):
    """IO9, ML5: two bags are trained, the first one is found again later."""
    registry = f"{fresh_dir(spark, 'model-registry')}"
    led, bag = _bag(spark, sf_dir)
    out = []
    for step, b in (("corrected", bag), ("as ingested", corrections.training_bag(led)), ("corrected again", bag)):
        models, reused = ml.train_or_reuse(b, registry)
        out.append((step, models.fp[0], models.fp[1], len(models.labels["expense"]), reused))
    return spark.createDataFrame(out, "step string, n long, h string, expense_classes long, reused boolean")


def _models(spark, sf_dir):
    led, bag = _bag(spark, sf_dir)
    return led, ml.train(bag)


def _misses(led):
    return led.where((F.col("transaction_type") == "Debit") & F.col("category").isNull())


def _ml_query(name: str):
    def q(spark, sf_dir):
        led, models = _models(spark, sf_dir)
        scored = models.score(_misses(led).select("account_id", "row_seq", "processed"), "processed")
        return scored.select("account_id", "row_seq", "processed",
                             F.col(f"ml_{name}").alias("label"), F.col(f"ml_{name}_conf").alias("confidence"))
    return q


# no SQL oracle: iterative fits (their optimum is checked by the gradient in the tests)
register("ml_debit_type")(_ml_query("debit_type"))
register("ml_expense")(_ml_query("expense"))
register("ml_savings")(_ml_query("savings"))


@register("ml_classified_ingest")
def q_ml_classified_ingest(spark, sf_dir):
    """C4 with the model fallback: the ledger re-ingested with a trained snapshot."""
    _, models = _models(spark, sf_dir)
    led = ingest.build_ledger(statements(spark, sf_dir), models)
    return led.select("account_id", "row_seq", "hash", "transaction_type", "category", "is_saving")


class ScoreTable:
    """Scores that follow from a text's length and last digit, in place of a fitted model."""

    def score(self, df, text_col):
        n = F.length(text_col)
        return df.withColumns({
            "ml_debit_type": F.when(n % 2 == 0, F.lit(SAVINGS)).otherwise(F.lit(EXPENSE)), "ml_debit_type_conf": (n % 10) / 10.0,
            "ml_savings": F.lit("Gold"), "ml_savings_conf": (n % 4) / 4.0, "ml_expense": F.lit("Travel"), "ml_expense_conf": (n % 7) / 7.0})

    classify_kwargs = ml.LedgerModels.classify_kwargs
    threshold = CONFIDENCE_THRESHOLD


@register("ml_thresholds", O.over_ledger(
    "SELECT account_id, row_seq, transaction_type, CASE WHEN is_saving = 1 AND category IS NULL THEN CASE WHEN sc > th THEN 'Gold' END "
    "WHEN category IS NULL AND transaction_type = 'Debit' THEN CASE WHEN ec > th THEN 'Travel' END ELSE category END AS category, is_saving FROM ("
    "SELECT * REPLACE (CASE WHEN transaction_type = 'Debit' AND category IS NULL AND n % 2 = 0 AND (n % 10) / 10.0::DOUBLE > th THEN 1 ELSE is_saving END AS is_saving), "
    f"(n % 4) / 4.0::DOUBLE AS sc, (n % 7) / 7.0::DOUBLE AS ec FROM (SELECT *, length(processed) AS n, {CONFIDENCE_THRESHOLD}::DOUBLE AS th FROM classified))"))
def q_ml_thresholds(spark, sf_dir):
    """C4, ML4, ML6: debits without a keyword take the scored type and category above the confidence threshold."""
    tx = ingest.prepare_transactions(statements(spark, sf_dir), ScoreTable())
    return tx.select("account_id", "row_seq", "transaction_type", "category", "is_saving")


# ---------------------------------------------------------------- ST1-ST3

def _uploaded(spark, sf_dir):
    """The transactions of all statement lines, parsed once for all uploads that hold some of them."""
    return written(ingest.prepare_transactions(statements(spark, sf_dir), keep_dropped=True), "uploads").where(F.col("amount").isNotNull())


def _ledger_rows(led):
    return led.select("account_id", "row_seq", "date", "month", "description", "processed",
                      F.col("amount").cast("double").alias("amount"), "transaction_type", "category",
                      "is_saving", "hash")


def _orders_stream(spark, sf_dir):
    prepare_session(spark)
    path = f"{sf_dir.rstrip('/')}/orders.parquet"
    schema = spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        f"{sf_dir.rstrip('/')}/orders*.parquet")
    return derive_statements(spread(src, "o_orderkey"), account=F.col("o_custkey"), seq=F.col("o_orderkey"),
                             idx=F.col("o_orderkey") % 26, day=F.col("o_orderdate"), price=F.col("o_totalprice"))


def _run_ingest_stream(spark, sf_dir) -> str:
    base = fresh_dir(spark, "stream-ingest")
    q = st.start_ingest(_orders_stream(spark, sf_dir), f"{base}/ledger", f"{base}/_checkpoint")
    q.awaitTermination()
    return f"{base}/ledger"


@register("stream_ingest", O.over_ledger(LEDGER_SELECT))
def q_stream_ingest(spark, sf_dir):
    return _ledger_rows(read_ledger(spark, _run_ingest_stream(spark, sf_dir)))


@register("ingest_upload_then_stream", O.over_ledger(LEDGER_SELECT))
def q_upload_then_stream(spark, sf_dir):
    """A stream into a ledger that an upload has started: the upload's rows stay, nothing repeats."""
    _, path = _stored_first_period(spark, sf_dir)
    st.start_ingest(_orders_stream(spark, sf_dir), path, f"{fresh_dir(spark, 'stream-after-upload')}/_checkpoint").awaitTermination()
    return _ledger_rows(read_ledger(spark, path))


@register("stream_dedup", O.over_ledger(
    "SELECT account_id, hash, date, " + O.dbl("amount") + " AS amount, transaction_type, category FROM ledger"))
def q_stream_dedup(spark, sf_dir):
    base = fresh_dir(spark, "stream-dedup")
    tx = ingest.prepare_transactions(_orders_stream(spark, sf_dir))
    d = st.dedupe_within_watermark(tx, "1 hour")
    q = (d.select("account_id", "hash", "date", F.col("amount").cast("double").alias("amount"),
                  "transaction_type", "category")
         .writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


_DAY = "TRY_CAST(try_strptime(date, '%Y-%m-%d') AS DATE)"


def _daily(spark, sf_dir):
    """Daily totals kept by a stream over two uploads, the later statement period first."""
    base = fresh_dir(spark, "stream-daily")
    tx = _uploaded(spark, sf_dir)
    for upload in (tx.where(F.col("date") >= SPLIT_DATE), tx):
        append_new(spark, upload, f"{base}/ledger", cache=False)
        st.start_daily_totals(spark, f"{base}/ledger", f"{base}/days", f"{base}/_checkpoint").awaitTermination()
    return st.daily_totals(spark, f"{base}/days")


@register("stream_daily", O.over_ledger(
    f"SELECT {_DAY} AS day, CAST(sum(amount) AS DOUBLE) AS total FROM ledger "
    f"WHERE transaction_type = 'Debit' AND {_DAY} IS NOT NULL GROUP BY 1"))
def q_stream_daily(spark, sf_dir):
    return _daily(spark, sf_dir).select("day", F.col("total").cast("double").alias("total"))


@register("stream_daily_replayed", O.over_ledger(
    f"SELECT {_DAY} AS day, CAST(sum(amount) AS DOUBLE) AS total FROM ledger "
    f"WHERE transaction_type = 'Debit' AND {_DAY} IS NOT NULL GROUP BY 1"))
def q_stream_daily_replayed(spark, sf_dir):
    """Daily totals of a ledger of which one batch is written again, before and after the store is compacted."""
    base = fresh_dir(spark, "stream-replayed")
    tx = _uploaded(spark, sf_dir)

    def update():
        st.start_daily_totals(spark, f"{base}/ledger", f"{base}/days", f"{base}/_checkpoint").awaitTermination()

    append_new(spark, tx.where(F.col("date") >= SPLIT_DATE), f"{base}/ledger", 0, writer="bank")
    for step in ("first", "again", "merged", "after"):
        if step == "merged":
            store.compact(spark, f"{base}/ledger")
        else:
            append_new(spark, tx, f"{base}/ledger", 1, writer="bank", cache=False)
        update()
    return st.daily_totals(spark, f"{base}/days").select("day", F.col("total").cast("double").alias("total"))


@register("stream_monthly", O.over_ledger(
    f"SELECT strftime({_DAY}, '%Y-%m') AS month, CAST(sum(amount) AS DOUBLE) AS total FROM ledger "
    f"WHERE transaction_type = 'Debit' AND {_DAY} IS NOT NULL GROUP BY 1"))
def q_stream_monthly(spark, sf_dir):
    return st.month_rollup(_daily(spark, sf_dir)).select("month", F.col("total").cast("double").alias("total"))


# ---------------------------------------------------------------- IO1, IO2, IO11 through real CSV files


@register("csv_ingest", O.over_ledger(
    "SELECT account_id, date, description, " + O.dbl("amount") +
    " AS amount, transaction_type, category, is_saving, hash FROM ledger"))
def q_csv_ingest(spark, sf_dir):
    """Statements exported as CSV (two header layouts, one reordered) and read back by header name."""
    base = fresh_dir(spark, "csv-ingest")
    lines = statements(spark, sf_dir)
    out = lines.select(
        F.col("account_id").alias("Account"), F.col("date_text").alias("Date"),
        F.col("narration").alias("Narration"), F.col("debit_text").alias("Debit Amount"),
        F.col("credit_text").alias("Credit Amount"), F.col("row_seq"),
    )
    even = (F.col("row_seq") % 2) == 0
    out.where(even).orderBy("row_seq").drop("row_seq").write.option("header", True).csv(f"{base}/a")
    out.where(~even).orderBy("row_seq").select(
        F.col("Credit Amount").alias(" Credit Amount "), "Narration", "Date", "Account", "Debit Amount",
    ).write.option("header", True).csv(f"{base}/b")
    st_lines = read_statement_csv(spark, [f"{base}/a", f"{base}/b"], account_column="Account")
    led = ingest.build_ledger(st_lines)
    return led.select("account_id", "date", "description", F.col("amount").cast("double").alias("amount"),
                      "transaction_type", "category", "is_saving", "hash")


# ---------------------------------------------------------------- IO3 + IO5 against a stored ledger


def _stored_first_period(spark, sf_dir):
    path = f"{fresh_dir(spark, 'incremental')}/ledger"
    tx = _uploaded(spark, sf_dir)
    append_new(spark, tx.where(F.col("date") < SPLIT_DATE), path)
    return tx, path


@register("ingest_incremental", O.over_ledger(
    "SELECT account_id, row_seq, date, " + O.dbl("amount") + " AS amount, transaction_type, category, hash "
    f"FROM ledger WHERE NOT (date < '{SPLIT_DATE}')"))
def q_ingest_incremental(spark, sf_dir):
    """The rows a full re-upload adds to a ledger that already holds the earlier period."""
    tx, path = _stored_first_period(spark, sf_dir)
    added = append_new(spark, tx, path, cache=False)
    return added.select("account_id", "row_seq", "date", F.col("amount").cast("double").alias("amount"),
                        "transaction_type", "category", "hash")


@register("ingest_incremental_report", O.over_ledger(
    "SELECT (SELECT count(*) FROM statement) AS total_rows, "
    f"(SELECT count(*) FROM ledger WHERE NOT (date < '{SPLIT_DATE}')) AS inserted, "
    f"(SELECT count(*) FROM classified) - (SELECT count(*) FROM ledger WHERE NOT (date < '{SPLIT_DATE}')) AS skipped, "
    "(SELECT count(*) FROM lines WHERE amount IS NULL) AS dropped, "
    f"(SELECT count(*) FROM ledger WHERE category IS NULL AND NOT (date < '{SPLIT_DATE}')) AS uncategorized"))
def q_ingest_incremental_report(spark, sf_dir):
    tx, path = _stored_first_period(spark, sf_dir)
    return ingest.ingest_report(statements(spark, sf_dir), store.known_keys(spark, path, tx))


@register("ingest_two_uploads", O.over_ledger(LEDGER_SELECT))
def q_ingest_two_uploads(spark, sf_dir):
    """The later statement period is uploaded first, then everything, then everything again."""
    path = f"{fresh_dir(spark, 'two-uploads')}/ledger"
    tx = _uploaded(spark, sf_dir)
    for upload in (tx.where(F.col("date") >= SPLIT_DATE), tx, tx):
        append_new(spark, upload, path, cache=False)
    return _ledger_rows(read_ledger(spark, path))


@register("ingest_odd_dates_twice", O.over_ledger(LEDGER_SELECT))
def q_ingest_odd_dates_twice(spark, sf_dir):
    """Everything, then once more only dates that no format parses (times among them) with a period that does not cover their months."""
    path = f"{fresh_dir(spark, 'odd-dates')}/ledger"
    tx = _uploaded(spark, sf_dir)
    odd = tx.where(F.col("txn_date").isNull() | (F.col("month") == AS_OF_MONTH))
    for upload in (odd, tx, odd):
        append_new(spark, upload, path, cache=False)
    return _ledger_rows(read_ledger(spark, path))


@register("ingest_compacted", O.over_ledger(LEDGER_SELECT))
def q_ingest_compacted(spark, sf_dir):
    """Uploads by thirds, merged in between; everything once more finds every stored key."""
    path = f"{fresh_dir(spark, 'compacted')}/ledger"
    tx = _uploaded(spark, sf_dir)
    for i in range(3):
        append_new(spark, tx.where(F.pmod("account_id", F.lit(3)) == i), path, cache=False)
        store.compact(spark, path)
    append_new(spark, tx, path, cache=False)
    return _ledger_rows(read_ledger(spark, path))


@register("ingest_no_account", O.over_ledger(
    "SELECT account_id, row_seq, date, " + O.dbl("amount") + " AS amount, category, hash FROM ("
    "SELECT * REPLACE (CAST(NULL AS BIGINT) AS account_id), row_number() OVER (PARTITION BY hash ORDER BY row_seq) AS rn2 FROM hashed) "
    "WHERE rn2 = 1"))
def q_ingest_no_account(spark, sf_dir):
    """One ledger without accounts, uploaded twice."""
    path = f"{fresh_dir(spark, 'no-account')}/ledger"
    lines = statements(spark, sf_dir).withColumn("account_id", F.lit(None).cast("long"))
    for _ in range(2):
        append_new(spark, ingest.prepare_transactions(lines), path)
    return read_ledger(spark, path).select(
        "account_id", "row_seq", "date", F.col("amount").cast("double").alias("amount"), "category", "hash")


@register("uncategorized_report", O.over_ledger(
    "SELECT account_id, row_seq, description, " + O.dbl("amount") + " AS amount, transaction_type AS type, hash "
    "FROM ledger WHERE category IS NULL"))
def q_uncategorized_report(spark, sf_dir):
    return ingest.uncategorized_report(ledger_of(spark, sf_dir))


# ---------------------------------------------------------------- IO7, IO8: written and read back


@register("export_csv", O.over_ledger(
    "SELECT account_id, date, description, " + O.dbl("amount") + " AS amount, category, "
    "row_number() OVER (ORDER BY date DESC, row_seq DESC, account_id DESC) AS position FROM ledger"))
def q_export_csv(spark, sf_dir):
    """The whole ledger as CSV, newest first, read back; the position shows the order of the lines."""
    path = f"{fresh_dir(spark, 'export')}/csv"
    led = ledger_of(spark, sf_dir)
    export_csv(led.select("account_id", "row_seq", "date", "description", "amount", "category", "source_file", "hash"), path)
    back = read_export(spark, path, (
        "account_id bigint, row_seq bigint, date string, description string, amount decimal(18,2), category string, source_file string, hash string"))
    return back.select("account_id", F.coalesce("date", F.lit("")).alias("date"), "description",
                       F.col("amount").cast("double").alias("amount"), "category", "position")


@register("snapshot", O.over_ledger(
    "SELECT 'ledger' AS table_name, count(*) AS n_rows, " + O.dbl("sum(amount)") + " AS total FROM ledger "
    "UNION ALL SELECT 'uncategorized', count(*), " + O.dbl("sum(amount)") + " FROM ledger WHERE category IS NULL"))
def q_snapshot(spark, sf_dir):
    led = ledger_of(spark, sf_dir)
    folder = snapshot({"ledger": led, "uncategorized": led.where(F.col("category").isNull())}, fresh_dir(spark, "snapshots"))
    parts = [spark.read.parquet(f"{folder}/{t}").agg(
        F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.sum("amount").cast("double").alias("total"))
        for t in ("ledger", "uncategorized")]
    return parts[0].unionByName(parts[1])
