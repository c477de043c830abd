"""The registered queries that have SQL, side by side with it."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.llm import catalog
from tests.conftest import SF
from tools.check import TABLES, compare


def test_every_operator_is_registered():
    names = entry.queries()
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(catalog.QUERIES) | {"pipeline"} <= set(names)
    assert set(catalog.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(name, spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    assert compare(got.toPandas(), con.execute(catalog.ORACLES[name]).df()) == ""
