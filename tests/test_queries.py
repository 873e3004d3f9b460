"""Every catalog query against its SQL in DuckDB: columns, rows and types."""

import duckdb
import pytest

from annalist.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    wanted = duck.sql(catalog.ORACLES[name])
    kinds = dict(zip(wanted.columns, map(str, wanted.types), strict=True))
    assert {c: TYPES[t] for c, t in got.dtypes} == kinds
    order = sorted(kinds)
    at = [wanted.columns.index(c) for c in order]
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in wanted.fetchall())))


def test_sample(spark, sf):
    share = catalog.QUERIES["subject_sample"](spark, sf)
    whole = {r[0]: r[1] for r in catalog.QUERIES["subject_index"](spark, sf).collect()}
    some = {r[0]: r[1] for r in share.groupBy("subject_id").count().collect()}
    assert 0 < len(some) < len(whole) / 3 and all(whole[k] == n for k, n in some.items())


def test_pushdown(spark, sf):
    plan = catalog.QUERIES["subject_lookup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,32)" in plan and "EqualTo(o_custkey,32)" in plan
    plan = catalog.QUERIES["subject_index"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["subject_id", "n_events"]
