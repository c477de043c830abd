"""Every registered query against its SQL oracle, by value, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tests.conftest import SF  # noqa: E402
from tools.check import TABLES, compare  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert compare(got, duck.execute(ORACLES[name]).df()) == ""
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
