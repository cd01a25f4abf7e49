"""Each registered query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from cairn.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: "~" if v is None else f"{round(float(v), 6) + 0.0:.6f}" if isinstance(v, int | float) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(rows, got.columns) == canonical(want.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["tx", "ty", "n", "z_min", "z_max"]
    assert set(e.oracle_sql()) <= set(e.queries())
