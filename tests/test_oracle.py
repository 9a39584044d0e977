"""Every query with an SQL text gives the same rows, names and types as it."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def duck(folder):
    con = connect(folder)
    yield con
    con.close()


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    missing = set(contract.queries()) - set(contract.oracle_sql())
    assert not {n for n in missing if n[0] in "asu"}


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if n[0] in "asu"))
def test_same_as_sql(spark, duck, folder, name):
    got = contract.queries()[name](spark, folder).toArrow()
    want = duck.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert compare(got, want) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["person", "attended", "expected", "rate"]
    assert df.count() > 0
