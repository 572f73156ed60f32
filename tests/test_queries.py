"""Every registered query against its DuckDB oracle on the smallest test tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from runlens.plans import catalog as C  # the llm queries have tests of their own

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(C.QUERIES) == set(C.ORACLE)
    assert set(C.QUERIES) <= set(E.queries()) and set(C.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = C.QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(C.ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "accuracy" in df.columns


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_column_types_match_oracle(spark, duck, name):
    df = C.QUERIES[name](spark, SF)
    spark_types = {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__)
                   for f in df.schema.fields}
    duck_types = {d[0]: str(d[1]) for d in duck.execute(C.ORACLE[name]).description}
    assert spark_types == duck_types
