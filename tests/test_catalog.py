"""Each query against its SQL, and plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from textsieve.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return str(x.tolist()) if hasattr(x, "tolist") else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    result = con.execute(catalog.ORACLE[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert columns == sorted(at)
    assert rows == sorted(str([plain(r[at[c]]) for c in columns]) for r in result.fetchall())


@pytest.mark.parametrize("name", ["phrase_match", "unordered_phrase_match", "candidate_probe", "surname_match", "span_page_overlap"])
def test_no_nested_loop(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
