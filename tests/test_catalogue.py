import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from logspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shown(v):
    return round(v, 9) if isinstance(v, float) else v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted([tuple(shown(r[k]) for k in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, db, name):
    df, sql = catalogue.QUERIES[name](spark, SF), db.sql(catalogue.SQL[name])
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["ingest_seq", "ts", "tenant_id", "body"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
