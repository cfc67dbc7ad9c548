import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session, tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("4")


@pytest.fixture(scope="session")
def db():
    return tables(SMALL)


@pytest.fixture
def orders(spark):
    return spark.read.parquet(f"{SMALL}/orders.parquet")
