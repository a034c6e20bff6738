"""Every query with SQL gives the rows that DuckDB gives, over the smallest tables."""

import os

import duckdb
import pytest

from tracewright import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def rows(values):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    found = catalog.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    relation = duck.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    want = [tuple(r[k] for k in places) for r in relation.fetchall()]
    assert rows(tuple(r[c] for c in columns) for r in found.collect()) == rows(want)


def test_entry_gives_verdicts(spark):
    import __spark_entry__ as entry

    assert {"subject", "outcome", "n"} == set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
