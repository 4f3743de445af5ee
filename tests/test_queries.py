"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from strandline.operators import qc
from tests.compare import compare, connect
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module", autouse=True)
def one_health_check():
    """The report queries share one run of the same check."""
    real, seen = qc.health_check, {}

    def once(o, channels, time_col=None, lineage=None, ordered=True):
        key = (o.n, tuple(channels), time_col)
        if key not in seen:
            seen[key] = real(o, channels, time_col, lineage, ordered)
        return seen[key]

    qc.health_check = once
    yield
    qc.health_check = real


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_findings(spark):
    kinds = {r.kind for r in entry.entry(spark).collect()}
    assert {"dead", "glitch", "time_gaps"} <= kinds
