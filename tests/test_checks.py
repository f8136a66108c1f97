"""Every registered query against its SQL check on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.compare import database, difference

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return database(small)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_matches_check(name, spark, small, con):
    problem, _rows = difference(QUERIES[name](spark, small), con, ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0
