"""The driver's gate, locally: every registered query with an oracle must
give the same rows as its DuckDB SQL at sf0.01."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from conftest import SF01
from tessera.plans import queries as Q

ORACLES = Q.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], ORACLES[name], SF01, con)
    assert r["ok"], r


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 40


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert set(df.columns) >= {"center_id", "x0", "x1", "kind", "n"}
    assert sum(r["n"] for r in rows) == 200
