import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import connect  # noqa: E402
from gavelstream.schemas import AUCTION, BID, PERSON  # noqa: E402
from gavelstream.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(microseconds=round(seconds * 1_000_000))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle_db():
    return connect(SF_DIR)


@pytest.fixture
def bids(spark):
    """Bids from (auction, bidder, price, seconds) tuples."""
    def make(*rows):
        return spark.createDataFrame([(a, b, p, "c", "u", at(s), "x") for a, b, p, s in rows], BID)

    return make


@pytest.fixture
def persons(spark):
    """Persons from (id, name, state, seconds) tuples."""
    def make(*rows):
        return spark.createDataFrame([(i, n, "e", "4", "city", st, at(s), "x") for i, n, st, s in rows], PERSON)

    return make


@pytest.fixture
def auctions(spark):
    """Auctions from (id, seller, category, opened, expires) tuples, times in seconds."""
    def make(*rows):
        return spark.createDataFrame([(i, "item", "d", 1, 2, at(o), at(e), s, c, "x") for i, s, c, o, e in rows],
                                     AUCTION)

    return make


def rows(df):
    return sorted(tuple(r) for r in df.collect())
