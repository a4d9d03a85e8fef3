"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from clonoform.plans.registry import ORACLE_SQL, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


def rows_of(rows):
    return sorted((tuple(normal(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES if not os.environ.get("ONLY") else os.environ["ONLY"].split(",")))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    got = df.collect()
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = cursor.fetchall()
    order = [columns.index(c) for c in df.columns]
    got, want = rows_of(got), rows_of([[r[i] for i in order] for r in want])
    assert len(got) == len(want)
    odd = [(g, w) for g, w in zip(got, want, strict=True) if not same(g, w)]
    assert not odd, odd[:3]
    assert got


def same(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5) or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and float(x) == float(y)) for x, y in zip(a, b, strict=True))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
