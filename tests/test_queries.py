"""Every query of the library against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from sieveworks import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: ("nan" if math.isnan(x) else f"{x:.9g}") if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    mine = rows_of([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.ORACLE_SQL:
        found = db.execute(catalog.ORACLE_SQL[name])
        assert mine == rows_of(found.fetchall(), [x[0] for x in found.description])
    else:
        assert mine[0]


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["group_key", "size", "digest", "files", "path"]
