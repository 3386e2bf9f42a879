"""Every query of the typing model against its SQL."""

import os

import pytest
from oracle import both

from typeloom.plans import further  # noqa: F401 registers its queries
from typeloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], SQL[name], SF)
    assert ours == theirs


def test_without_sql(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, SF).count() > 0
