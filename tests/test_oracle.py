"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as E
from docket.queries import ORACLE, QUERIES
from docket.testing import SF_SMALL, compare, duck


KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) and QUERIES.keys() <= E.queries().keys()


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    ok, msg = compare(df, con, E.oracle_sql()[key])
    assert ok, msg


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 9
    assert set(E.entry(spark).columns) == {"relevance_level", "support_level", "n_cases"}
