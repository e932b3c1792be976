"""Every registered query with a DuckDB text gives that text's answer; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(small, f"{table}.parquet")
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    yield connection
    connection.close()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return None if math.isnan(number) else number
    return str(value)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return a == b


def order(row):
    return tuple((v is not None, str(v) if not isinstance(v, float) else f"{v:024.4f}") for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[p]) for p in places) for r in cursor.fetchall()), key=order)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["v15_partition_loads", "m05_forest_scores", "m07_random_forest", "m18_m19_m22_sequence_scores"])
def test_models_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_texts_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
