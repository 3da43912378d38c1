"""Every query of the engine over the smallest test data, against its SQL where it has one."""

import math
from collections import Counter

import duckdb
import pytest

from lineweave.plans import oracle, queries


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def sql(sf):
    import os

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, sql, name):
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in oracle.ORACLES:
        r = sql.execute(oracle.ORACLES[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(df.columns)
        want = Counter(tuple(normal(x[columns.index(c)]) for c in sorted(columns)) for x in r.fetchall())
        assert Counter(tuple(normal(x[c]) for c in sorted(columns)) for x in rows) == want
