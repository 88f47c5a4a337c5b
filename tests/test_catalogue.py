"""Every catalogue query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from cellweave.functions import catalogue

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(data, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def clean(x):
        return None if isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), names)
