"""Every query that has SQL gives the rows of its SQL."""

import math

import duckdb
import pytest

from waylark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    found = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_others_give_the_same_rows_however_they_are_dealt(spark, name):
    """Rows, and the same ones with another number of partitions."""
    data = "/root/testdata/sf0.01"  # suppliers are too few below for arcs
    rows = lambda: sorted(str(r) for r in catalog.QUERIES[name](spark, data).collect())
    first = rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first and rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
