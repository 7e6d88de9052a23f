"""The ledger store: key index, commit log, replays, compaction, change feed."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import statement, write_csv
from finledger.operators import ingest
from finledger.operators import ledger as rows
from finledger.sources import manifest, store
from finledger.sources.csv import read_statement_csv
from finledger.streaming import ingest_stream as st


@pytest.fixture
def make_tx(spark, tmp_path):
    n = iter(range(100))

    def make(*lines):
        return ingest.prepare_transactions(read_statement_csv(spark, write_csv(tmp_path, f"u{next(n)}", statement(*lines)), account_id=1))
    return make


def test_dates_with_a_time_are_stored_once(spark, tmp_path, make_tx):
    """The stored copy has a month like any other, outside the months that the batch could parse."""
    path = str(tmp_path / "ledger")
    lines = ["2024-01-05 10:00:00,KFC BUCKET,640,0", "2023-07-04,PIZZA NIGHT,300,0", "a|B,X,1,0", "a,B|X,1,0", ",NO DATE,2,0"]
    for _ in range(2):
        store.append_new(spark, make_tx(*lines), path)
    assert store.read_ledger(spark, path).count() == 5 - 1   # "a|B|X|1.0" twice: one hash


def daily(spark, tmp_path):
    st.start_daily_totals(spark, str(tmp_path / "ledger"), str(tmp_path / "days"), str(tmp_path / "ck")).awaitTermination()
    return {str(r.day): float(r.total) for r in st.daily_totals(spark, str(tmp_path / "days")).collect()}


def contents(spark, path):
    return sorted((r.date, r.processed, r.writer, r.batch) for r in store.read_ledger(spark, path).collect())


def test_replays_and_compaction_change_no_total(spark, tmp_path, make_tx):
    path = str(tmp_path / "ledger")
    a, b = make_tx("2023-06-05,KFC BUCKET,640,0", ",BLANK DATE,7,0"), make_tx("2023-06-05,KFC BUCKET,640,0", "2023-01-02,PIZZA NIGHT,300,0")
    store.append_new(spark, a, path, 0, writer="w")
    assert store.append_new(spark, b, path, 1, writer="w").count() == 1
    want, held = {"2023-06-05": 640.0, "2023-01-02": 300.0}, contents(spark, path)
    assert daily(spark, tmp_path) == want
    store.append_new(spark, a, path, 0, writer="w")              # replay of an older batch
    assert contents(spark, path) == held and daily(spark, tmp_path) == want
    merged = store.compact(spark, path)
    assert merged.batches == (("w", 0, 1),) and contents(spark, path) == held and daily(spark, tmp_path) == want
    assert store.compact(spark, path) is None
    store.append_new(spark, b, path, 1, writer="w")              # replay of a merged batch
    assert [v.gone for v in manifest.state(spark, path).live] == [(("w", 1),), ()]
    assert contents(spark, path) == held and daily(spark, tmp_path) == want
    store.append_new(spark, make_tx("2023-06-05,KFC BUCKET,640,0", "2023-06-05,NYKAA BOX,60,0"), path)
    want["2023-06-05"] += 60
    assert daily(spark, tmp_path) == want
    last = store.compact(spark, path)
    assert not last.gone and len(manifest.state(spark, path).live) == 1 and daily(spark, tmp_path) == want
    assert store.append_new(spark, b, path, 2, writer="w").count() == 0      # the index of the merged version


def test_files_stay_bounded_and_dead_versions_go(spark, tmp_path, make_tx):
    path = str(tmp_path / "ledger")
    for day in range(1, 6):
        store.append_new(spark, make_tx(f"2023-06-{day:02d},KFC BUCKET,640,0"), path)
    store.compact(spark, path)
    assert store.read_ledger(spark, path).count() == 5 and len(store.read_ledger(spark, path).inputFiles()) == 1
    assert store.vacuum(spark, path) == 0                        # too young
    assert store.vacuum(spark, path, older_than_hours=-1) == 10
    assert len(os.listdir(f"{path}/rows")) == 1 and store.read_ledger(spark, path).count() == 5


def test_two_uploads_at_the_same_moment(spark, tmp_path, make_tx, monkeypatch):
    path = str(tmp_path / "ledger")
    store.append_new(spark, make_tx("2023-06-01,FIRST,1,0"), path)
    write, done = store._write_version, []

    def slow(*args):
        version = write(*args)
        if not done:
            done.append(1)
            store.append_new(spark, make_tx("2023-06-02,KFC BUCKET,640,0"), path)      # commits in between
        return version
    monkeypatch.setattr(store, "_write_version", slow)
    added = store.append_new(spark, make_tx("2023-06-02,KFC BUCKET,640,0", "2023-06-03,NYKAA BOX,60,0"), path)
    assert [r.processed for r in added.collect()] == ["NYKAA BOX"]
    assert sorted(r.processed for r in store.read_ledger(spark, path).collect()) == ["FIRST", "KFC BUCKET", "NYKAA BOX"]


def test_a_batch_that_was_not_committed_does_not_count(spark, tmp_path, make_tx, monkeypatch):
    path = str(tmp_path / "ledger")
    store.append_new(spark, make_tx("2023-06-01,FIRST,1,0"), path)

    def lost(*args, **kwargs):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", lost)
        with pytest.raises(RuntimeError):
            store.append_new(spark, make_tx("2023-06-02,KFC BUCKET,640,0"), path)
    assert store.read_ledger(spark, path).count() == 1
    assert store.append_new(spark, make_tx("2023-06-02,KFC BUCKET,640,0"), path).count() == 1


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_month_reads_its_folder_only(spark, tmp_path, make_tx):
    path = str(tmp_path / "ledger")
    store.append_new(spark, make_tx("2023-06-01,FIRST,1,0", "2023-07-01,SECOND,1,0", ",BLANK,1,0"), path)
    led = store.read_ledger(spark, path)
    scans = [x for x in plan(rows.month_slice(led, "2023-06")).split("== Physical Plan ==")[1].splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "(month" in scans[0].split("PartitionFilters:")[1].split("PushedFilters")[0] and "= 2023-06" in scans[0]
    assert rows.month_slice(led, "2023-06").count() == 1 and led.where("month = ''").count() == 1
    keys = store.known_keys(spark, path, make_tx("2023-06-09,OTHER,1,0"))
    scan = next(x for x in plan(keys).split("== Physical Plan ==")[1].splitlines() if "FileScan" in x)
    assert "bucket" in scan.split("PartitionFilters:")[1] and keys.count() >= 1


def test_a_report_against_the_index(spark, tmp_path, make_tx):
    path = str(tmp_path / "ledger")
    store.append_new(spark, make_tx("2023-06-01,FIRST,1,0"), path)
    src = write_csv(tmp_path, "r", statement("2023-06-01,FIRST,1,0", "2023-06-02,KFC BUCKET,640,0", "2023-06-02,KFC BUCKET,640,0", "x,y,z,0"))
    lines = read_statement_csv(spark, src, account_id=1)
    r = ingest.ingest_report(lines, store.known_keys(spark, path, ingest.prepare_transactions(lines))).first()
    assert (r.total_rows, r.inserted, r.skipped, r.dropped, r.uncategorized) == (4, 1, 2, 1, 0)


def test_other_keys_are_refused(spark, tmp_path, make_tx):
    with pytest.raises(ValueError):
        store.append_new(spark, make_tx("2023-06-01,FIRST,1,0"), str(tmp_path / "ledger"), key=("date",))
