"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lithoframe import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([None if r[i] is None else round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = plans.queries()[name](spark, SF)
    sql = con.sql(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", ["src_08_markdown_kinds", "val_01_integrity", "topk_02_samples", "scal_s21_stable_ids"])
def test_other_queries_give_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
