"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge import catalog
from folioforge.plans.views import BASE

ROOT = os.environ.get("FOLIOFORGE_TEST_DIR", "/root/testdata")
DIRS = [f"{ROOT}/sf0.001", f"{ROOT}/sf0.01"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRS[0]), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    """A connection for each folder."""
    found = {}
    for folder in DIRS:
        con = found[folder] = duckdb.connect()
        for name in BASE:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return found


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("folder", DIRS, ids=os.path.basename)
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees(spark, duck, name, folder):
    df = catalog.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    mine = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    res = duck[folder].execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    theirs = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    """No SQL: a row at least, no column that is null throughout, and the same rows again."""
    made = [sorted(str([plain(v) for v in r]) for r in catalog.QUERIES[name](spark, DIRS[0]).collect()) for _ in range(2)]
    assert made[0] and made[0] == made[1]
    df = catalog.QUERIES[name](spark, DIRS[0])
    some = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    assert all(some)
