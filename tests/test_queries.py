"""Every query of the audit engine runs at the smallest size, and gives what its SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewater.plans.queries import QUERIES, SQL

TABLES = ["conversations", "documents", "events", "pages"]


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((rounded(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    con.execute(SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    assert got == sorted((rounded(r[names.index(c)] for c in columns) for r in con.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
