"""Every query of the reference's operators against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from scenegrain import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"m11_mlp", "m12_self_training", "m14_learning_curve"}


@pytest.fixture(scope="module")
def duck(small_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, small_dir, name):
    if name in SLOW:
        pytest.skip("trains networks; covered by tests of parts")
    df = catalog.queries()[name](spark, small_dir)
    names = sorted(df.columns)
    rows = df.collect()
    if sql := catalog.oracle_sql().get(name):
        rel = duck.sql(sql)
        assert sorted(rel.columns) == names
        at = [rel.columns.index(n) for n in names]
        assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == sorted(tuple(plain(w[i]) for i in at) for w in rel.fetchall())
    else:
        assert rows


def test_names_cover_sql():
    assert catalog.oracle_sql().keys() <= catalog.queries().keys()
