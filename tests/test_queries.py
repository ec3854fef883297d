"""Every query that has SQL, against DuckDB on the smallest test tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from graphlume.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def test_every_oracle_has_a_query():
    assert not ORACLES.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(ORACLES[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    wanted = Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in answer.fetchall())
    assert got == wanted
