"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.compare import compare
from checks.oracles import ORACLES
from checks.queries import QUERIES

from .conftest import SMALL


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, db):
    status, note = compare(spark, db, SMALL, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "rows"), f"{status}: {note}"
