"""Every query against its SQL in DuckDB, at sf0.001."""

from __future__ import annotations

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, name, query, sql):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = query(spark, SF)
    columns = sorted(df.columns)
    r = c.execute(sql)
    other = [d[0] for d in r.description]
    assert sorted(other) == columns, name
    got = sorted((tuple(plain(x[k]) for k in columns) for x in df.collect()), key=repr)
    want = sorted((tuple(plain(x[other.index(k)]) for k in columns) for x in r.fetchall()), key=repr)
    assert got == want, name


def test_core_queries_equal_their_sql(spark):
    from skylattice import queries, search_queries  # noqa: F401

    for name, sql in queries.ORACLES.items():
        compare(spark, name, queries.QUERIES[name], sql)


def test_queries_without_sql_run(spark):
    from skylattice import queries, search_queries  # noqa: F401

    for name in queries.QUERIES.keys() - queries.ORACLES.keys():
        assert queries.QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys()
    assert __spark_entry__.entry(spark).count() == 1


def test_filters_and_columns_reach_the_scan(spark):
    from skylattice import queries

    plan = queries.QUERIES["retained_at_thresholds"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan
    plan = queries.QUERIES["nearest_within_tolerance"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
