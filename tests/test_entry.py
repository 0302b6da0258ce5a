import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in entry.oracle_sql():
        return
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = c.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    show = lambda v: repr(round(float(v), 5)) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)
    assert sorted(tuple(show(r[k]) for k in sorted(df.columns)) for r in rows) == sorted(tuple(show(r[want.columns.index(k)]) for k in sorted(df.columns)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 3
