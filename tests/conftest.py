import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from finledger.operators import ingest  # noqa: E402
from finledger.session import local_session, prepare_session  # noqa: E402
from finledger.sources.csv import read_statement_csv  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("*", 8, app="finledger-tests")
    # tests run without a cluster: name a checkpoint folder only because none is set
    if not s.sparkContext.getConf().get("spark.checkpoint.dir", None) and s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    prepare_session(s)
    yield s
    s.stop()


@pytest.fixture
def csv_ledger(spark, tmp_path):
    """Ingest inline CSV text the way an upload is ingested; returns the ledger."""
    counter = {"n": 0}

    def make(text: str, name: str | None = None):
        counter["n"] += 1
        d = tmp_path / f"upload{counter['n']}"
        d.mkdir()
        (d / (name or "statement.csv")).write_text(text)
        lines = read_statement_csv(spark, str(d), account_id=1)
        return ingest.build_ledger(lines)

    return make


def write_csv(tmp_path, name: str, text: str) -> str:
    d = tmp_path / name
    d.mkdir(parents=True, exist_ok=True)
    (d / "statement.csv").write_text(text)
    return str(d)


HEADER = "Date,Narration,Debit Amount,Credit Amount"


def statement(*lines: str) -> str:
    return "\n".join([HEADER, *lines]) + "\n"


# A quarter with one salary, one meal, one purchase and one retirement deposit a month.
QUARTER = statement(
    "2023-04-01,PAYROLL APRIL,0,42000", "2023-04-06,DOMINOS PARTY,720,0", "2023-04-11,MYNTRA SHOES,2400,0", "2023-04-28,PPF DEPOSIT,3500,0",
    "2023-05-01,PAYROLL MAY,0,43500", "2023-05-09,KFC BUCKET,580,0", "2023-05-17,AJIO JACKET,3600,0", "2023-05-28,PPF DEPOSIT,3500,0",
    "2023-06-01,PAYROLL JUNE,0,45600", "2023-06-08,DOMINOS PARTY,980,0", "2023-06-19,MYNTRA SHOES,1500,0", "2023-06-28,PPF DEPOSIT,3500,0",
)

# Two months with several kinds of spending and a flat investment.
AUTUMN = statement(
    "2023-08-01,PAYROLL AUGUST,0,60000", "2023-08-03,KFC BUCKET,1800,0", "2023-08-09,PIZZA NIGHT,1300,0", "2023-08-14,NYKAA BOX,4200,0",
    "2023-08-16,SPOTIFY FAMILY,350,0", "2023-08-21,GROWW TRANSFER,6000,0", "2023-08-26,RAPIDO RIDE,900,0",
    "2023-09-01,PAYROLL SEPTEMBER,0,60000", "2023-09-07,PIZZA NIGHT,2700,0", "2023-09-13,NYKAA BOX,2600,0", "2023-09-21,GROWW TRANSFER,6000,0",
)

# Spending without a category in two plain and two festive months.
FESTIVE_YEAR = statement(
    "2022-03-07,MARKET STALL,1500,0", "2022-05-07,MARKET STALL,2100,0", "2022-10-11,LANTERN FAIR,7000,0",
    "2022-10-19,SWEET BOX,4400,0", "2022-12-22,TREE LIGHTS,5200,0",
)
