"""Every query over the smallest test data; against SQL where there is some."""

from collections import Counter

import duckdb
import pytest

from lineweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in queries.ORACLES:
        c = duckdb.connect()
        c.execute(f"create view routine_rows as select * from '{sf}/routine_rows.parquet'")
        r = c.execute(queries.ORACLES[name])
        columns = [d[0] for d in r.description]
        assert Counter(tuple(x[k] for k in columns) for x in rows) == Counter(r.fetchall())
