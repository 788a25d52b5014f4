"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from darkspace import catalog

DIR = "/root/testdata/sf0.001"


def rows(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(x):
        return repr(round(x, 9)) if isinstance(x, float) else str(x)

    return sorted(tuple(value(r[k]) for k in order) for r in records)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DIR):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    expected = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    got = catalog.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, expected.fetchall())


def test_every_query_is_named():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
