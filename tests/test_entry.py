"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from audit_queries import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
NAMES = sorted(catalog.QUERIES)
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
