"""Text models (ML0-ML6) and streaming ingest (ST1-ST3)."""

import pytest
from pyspark.sql import functions as F

from conftest import AUTUMN, QUARTER, write_csv
from finledger.operators import ingest, ml
from finledger.sources.csv import read_statement_csv
from finledger.sources.store import read_ledger
from finledger.streaming import ingest_stream as st

SAMPLES = [
    ("CAFE MOCHA", "Food & Dining"), ("BURGER BARN", "Food & Dining"), ("NOODLE HOUSE", "Food & Dining"),
    ("SNEAKER SHOP", "Shopping"), ("KURTA BOUTIQUE", "Shopping"), ("WATCH STORE", "Shopping"),
    ("CAB HOME", "Transportation"), ("AUTO STAND", "Transportation"), ("INDEX FUND PLAN", "Mutual Fund SIP"),
    ("TERM COVER", "Insurance"), ("BANK TERM SAVER", "Fixed Deposit"),
    ("MUSIC MONTHLY", "Subscriptions"), ("FILM MONTHLY", "Subscriptions"),
]


@pytest.fixture(scope="module")
def models(spark):
    bag = spark.createDataFrame(SAMPLES, "description string, category string")
    return ml.train(bag, max_iter=200)


def test_no_training_data(spark):
    assert ml.train(spark.createDataFrame([], "description string, category string")) is None


def test_train_and_predict(spark, models):
    texts = spark.createDataFrame([("CAFE MOCHA LATTE",), ("SNEAKER SHOP ONLINE",), ("INDEX FUND TOP UP",)], "t string")
    rows = models.score(texts, "t").collect()
    for r in rows:
        assert r.ml_debit_type in ("Expense", "Savings/Investment")
        assert r.ml_expense is not None and r.ml_savings is not None
        for c in (r.ml_debit_type_conf, r.ml_expense_conf, r.ml_savings_conf):
            assert 0.0 <= c <= 1.0
    assert {r.ml_expense for r in rows} <= {"Food & Dining", "Shopping", "Transportation", "Subscriptions", "Other"}


def test_retrain_skipped_when_unchanged(spark, models):
    bag = spark.createDataFrame(list(reversed(SAMPLES)), "description string, category string")
    assert ml.train(bag, previous=models) is models      # order-free fingerprint


def test_single_class_model_skipped(spark):
    bag = spark.createDataFrame([("TEA", "Food & Dining"), ("SCARF", "Shopping")], "description string, category string")
    m = ml.train(bag, max_iter=50)
    assert set(m.labels) == set(m.intercepts) == {"expense"}
    r = m.score(spark.createDataFrame([("X",)], "t string"), "t").first()
    assert (r.ml_debit_type, r.ml_debit_type_conf) == (None, 0.0)


def test_save_load(spark, models, tmp_path):
    path = str(tmp_path / "models")
    models.save(path)
    back = ml.LedgerModels.load(spark, path)
    texts = spark.createDataFrame([("CAB HOME LATE",)], "t string")
    a, b = models.score(texts, "t").first(), back.score(texts, "t").first()
    assert back.fp == models.fp and back.labels == models.labels and back.intercepts == models.intercepts
    assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_weights_are_optimal(spark, models):
    bag = spark.createDataFrame(SAMPLES * 2 + SAMPLES[:5], "description string, category string")
    m = ml.train(bag)
    for name in ml.MODEL_NAMES:
        assert ml.gradient_norm(m, bag, name) < 1e-3
        shifted = ml.LedgerModels(m.path, m.labels, {k: [x + 0.5 * i for i, x in enumerate(v)] for k, v in m.intercepts.items()}, fp=m.fp)
        assert ml.gradient_norm(shifted, bag, name) > 1e-2


def test_features_by_hand(spark):
    import math

    wbag = spark.createDataFrame([("A1 tea Tea", "x", 2.0), ("tea x9", "x", 1.0), ("", "y", 1.0), ("é", "y", 1.0)], "description string, category string, weight double")
    terms = ml.term_table(wbag)
    assert [(r.term, r.term_id, r.df) for r in terms.orderBy("term").collect()] == [
        ("a1", 0, 2.0), ("a1 tea", 1, 2.0), ("tea", 2, 3.0), ("tea tea", 3, 2.0), ("tea x9", 4, 1.0), ("x9", 5, 1.0)]
    idf = {r.term: math.log(6 / (1 + r.df)) + 1 for r in terms.collect()}
    got = {(r.text, r.term): r.weight for r in ml.features(wbag.select(F.col("description").alias("text")), terms).collect()}
    x = {"a1": idf["a1"], "a1 tea": idf["a1 tea"], "tea": 2 * idf["tea"], "tea tea": idf["tea tea"]}
    norm = math.sqrt(sum(v * v for v in x.values()))
    assert {t: got["A1 tea Tea", t] for t in x} == pytest.approx({t: v / norm for t, v in x.items()}) and len(got) == 7


def test_registry_finds_any_earlier_bag(spark, tmp_path):
    bag = spark.createDataFrame(SAMPLES, "description string, category string")
    other = spark.createDataFrame(SAMPLES[1:], "description string, category string")
    path = str(tmp_path / "registry")
    assert [ml.train_or_reuse(b, path, 5)[1] for b in (bag, other, bag.orderBy("description"), other)] == [False, False, True, True]
    assert ml.train_or_reuse(bag.limit(0), path) == (None, False)


def test_ml_fallback_only_for_keyword_misses(spark, models, tmp_path):
    path = write_csv(tmp_path, "a", "Date,Narration,Debit Amount,Credit Amount\n2023-07-10,KFC BUCKET,640,0\n"
                                    "2023-07-11,GROWW TRANSFER,100,0\n2023-07-12,NEW NOODLE PLACE,50,0\n"
                                    "2023-07-13,ODD CREDIT,0,50\n")
    lines = read_statement_csv(spark, path, account_id=1)
    base = {r.processed: r.category for r in ingest.build_ledger(lines).collect()}
    withml = {r.processed: (r.category, r.is_saving) for r in ingest.build_ledger(lines, models).collect()}
    for text, cat in base.items():
        if cat is not None:
            assert withml[text][0] == cat                # keyword hits never change
    assert withml["ODD CREDIT"][0] is None           # credits never use the model


def test_stream_equals_batch(spark, tmp_path):
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    lines = QUARTER.strip().splitlines()
    header, body = lines[0], lines[1:]
    (incoming / "part1.csv").write_text("\n".join([header, *body[:7]]) + "\n")
    (incoming / "part2.csv").write_text("\n".join([header, *body[5:]]) + "\n")   # overlaps two lines
    ledger_path, ckpt = str(tmp_path / "ledger"), str(tmp_path / "ckpt")
    q = st.start_ingest(st.statement_csv_stream(spark, str(incoming), account_id=1), ledger_path, ckpt)
    q.awaitTermination()
    streamed = read_ledger(spark, ledger_path)
    batch = ingest.build_ledger(read_statement_csv(spark, write_csv(tmp_path, "all", QUARTER), account_id=1))
    key = lambda df: sorted((r.hash, r.category) for r in df.select("hash", "category").collect())
    assert key(streamed) == key(batch)
    # a restart over the same files with the same checkpoint adds nothing
    q = st.start_ingest(st.statement_csv_stream(spark, str(incoming), account_id=1), ledger_path, ckpt)
    q.awaitTermination()
    assert read_ledger(spark, ledger_path).count() == batch.count()


def test_stream_daily_totals(spark, tmp_path):
    from finledger.sources.store import append_new
    ledger_path = str(tmp_path / "ledger")
    path = write_csv(tmp_path, "a", AUTUMN)
    append_new(spark, ingest.prepare_transactions(read_statement_csv(spark, path, account_id=1)), ledger_path)
    out = str(tmp_path / "daily")
    st.start_daily_totals(spark, ledger_path, out, str(tmp_path / "ck")).awaitTermination()
    daily = st.daily_totals(spark, out)
    assert daily.agg(F.sum("total")).first()[0] == 25850
    months = {r.month: float(r.total) for r in st.month_rollup(daily).collect()}
    assert months == {"2023-08": 14550.0, "2023-09": 11300.0}
