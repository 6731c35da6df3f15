"""Every relational query against its SQL in DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from lakeloom.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, float | decimal.Decimal):
        return float(f"{v:.9g}")
    return v


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    assert rows(df.select(*names).collect()) == rows(want.project(", ".join(f'"{c}"' for c in names)).fetchall())


def test_sample_is_the_same_on_any_partitioning(spark):
    from lakeloom.operators.sampling import bernoulli

    df = spark.range(10_000)
    one, two = (sorted(r.id for r in bernoulli(df.repartition(n), 0.2, ["id"]).collect()) for n in (1, 7))
    assert one == two and 1700 < len(one) < 2300


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
