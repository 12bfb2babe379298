"""Every registered query that has an SQL counterpart, against it, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as contract
from tools.check import TABLES
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables written meanwhile: the steps behind ``materialise``."""
    seen = []

    def watched(write):
        def run(self, *args, **options):
            seen.append(self._df._jdf.queryExecution().toString())
            return write(self, *args, **options)

        return run

    for name in ("parquet", "text"):
        monkeypatch.setattr(DataFrameWriter, name, watched(getattr(DataFrameWriter, name)))
    return seen


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, con, plans, name):
    frame = contract.queries()[name](spark, SF)
    for plan in [*plans, frame._jdf.queryExecution().toString()]:
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    columns = sorted(frame.columns)
    got = [tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    names = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {names} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert sorted(got, key=key) == sorted(want, key=key)


def test_every_engine_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
