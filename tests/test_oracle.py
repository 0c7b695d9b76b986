"""Every registered query equals its independent DuckDB SQL exactly (sf0.001)."""

import pytest

from conftest import SF_SMALL

from __spark_entry__ import entry, oracle_sql, queries
from sitewatt.plans.catalog import QUERIES
from sitewatt.plans.verify import compare, duck_connect

NAMES = sorted(QUERIES)  # the text operators have tests of their own


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


def test_every_query_has_oracle():
    missing = [n for n in NAMES if n not in oracle_sql()]
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name, monkeypatch):
    from sitewatt.plans import verify
    monkeypatch.setattr(verify, "STRICT", True)  # exact values, floats bit for bit
    r = compare(spark, duck, name, queries()[name], oracle_sql()[name], SF_SMALL)
    assert r["cols"], (r["spark_cols"], r["oracle_cols"])
    assert r["rows"], (r["n"], r["n_oracle"])
    assert r["values"], r["diff"]


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert df.columns[:3] == ["ts", "room_id", "room_name"]
    assert len(rows) >= 0
