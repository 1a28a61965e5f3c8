"""Every registered query of the engine against DuckDB on the same files."""

import math

import duckdb
import pytest

from marlstone import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in got), key=repr)


@pytest.mark.parametrize("name", CASES)
def test_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, D)
    res = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, res.fetchall())


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.queries()["page_text"](spark, D).count() > 0
