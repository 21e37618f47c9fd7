"""Each query of the catalogue against its SQL on DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from weftline import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in catalog.TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, row)) for row in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_aggregates_are_fused(spark):
    plan = catalog.query("pricing_summary")(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "PushedFilters: [IsNotNull(l_shipdate)" in plan
    schema = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert "l_orderkey" not in schema and "l_quantity" in schema


def test_entry_points():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
