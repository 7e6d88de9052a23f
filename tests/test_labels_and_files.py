"""Keyword automaton against the nested loop; one scan of statement files."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import statement, write_csv
from finledger.functions.classify import keyword_category
from finledger.sources.csv import read_statement_csv
from finledger.taxonomy import ordered_categories

ALL = [(category, k) for _, _, category, keywords in ordered_categories() for k in keywords]


def first_hit(text):
    return None if text is None else next((c for c, k in ALL if k in text), None)


def test_every_text_gets_the_first_category_of_the_dictionary(spark):
    rng = random.Random(7)
    words = [k for _, k in ALL]

    def part():
        k = rng.choice(words)
        return rng.choice([k, k[:rng.randint(1, len(k))], k[rng.randint(0, 3):], " ", "-", "A1SIP", "RENT", "UBERRIDE", "x"])
    texts = ["", None, *words, *["".join(part() for _ in range(rng.randint(1, 6))) for _ in range(4000)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keyword_category("t").alias("c")).collect()
    assert [(r.t, r.c) for r in rows if r.c != first_hit(r.t)] == []


def test_whole_words(spark):
    texts = ["RENT", "PARENT", "A RENT-B", "MY SIP", "GOSSIP", "SALARY,X", "ÉRENT", "RENT_1", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(keyword_category("t", "word")).collect()]
    assert got == ["Rent", None, "Rent", "Mutual Fund SIP", None, "Salary", None, None, None, None]
    with pytest.raises(ValueError):
        keyword_category("t", "other")


def test_statement_files_are_one_scan(spark, tmp_path):
    src = write_csv(tmp_path, "a", statement("2023-07-04,KFC BUCKET,640,0", "2023-07-05,Date Narration Debit Amount Credit Amount,1,0"))
    lines = read_statement_csv(spark, src, account_id=1)
    plan = lines._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan csv") == 1 and "FileScan text" not in plan and plan.count("FileScan") == 2
    assert [r.narration for r in sorted(lines.collect(), key=lambda r: r.row_seq)] == ["KFC BUCKET", "Date Narration Debit Amount Credit Amount"]


@pytest.mark.parametrize("header,missing", [("Date,Narration,Debit Amount", "Credit Amount"), ("a,b", "Date"), ("Date Narration Debit Amount Credit Amount,x", "Date")])
def test_a_missing_column_is_named(spark, tmp_path, header, missing):
    good = write_csv(tmp_path, "good", statement("2023-07-04,KFC BUCKET,640,0"))
    bad = write_csv(tmp_path, "bad", f"{header}\n1,2,3\n")
    with pytest.raises(ValueError, match=missing):
        read_statement_csv(spark, [good, bad], account_id=1).count()


def test_no_files_are_an_error(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no statement files"):
        read_statement_csv(spark, str(tmp_path / "none"))


def test_empty_file_beside_others(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text(statement("2023-07-04,KFC BUCKET,640,0"))
    (d / "b.csv").write_text("")
    assert read_statement_csv(spark, str(d), account_id=1).select(F.count("*")).first()[0] == 1
