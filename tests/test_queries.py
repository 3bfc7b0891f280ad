"""Every registered query against its SQL on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from workload import AREAS

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
NAMES = [name for area in AREAS for name in area.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_registry():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    answer = db.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in place) for r in answer.fetchall()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
