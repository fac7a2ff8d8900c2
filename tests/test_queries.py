"""Every query with SQL against DuckDB, and the contract of the entry module."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["lang", "position", "clauses", "tokens"]


def test_queries_equal_their_sql(spark):
    from lexfold.plans import queries as plans
    from lexfold.plans import round_trips, variants  # noqa: F401

    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    wrong = []
    for name, sql in plans.ORACLE_SQL.items():
        df = plans.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        rel = duck.sql(sql)
        names = list(rel.columns)
        if sorted(names) != columns or got != sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr):
            wrong.append(name)
    assert not wrong


def test_queries_without_sql_run(spark):
    from lexfold.plans import queries as plans

    for name in set(plans.QUERIES) - set(plans.ORACLE_SQL):
        assert plans.QUERIES[name](spark, SF).count() > 0, name
