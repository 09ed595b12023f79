"""Every query with SQL against DuckDB on the smallest tables; plans of some."""

import duckdb
import pytest

from sedimenta import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tidy = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert tidy(got) == tidy(want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_masks_join_by_equality(spark):
    plan = _plan(catalogue.queries()["recursive_delete_masked"](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_are_pruned(spark):
    plan = _plan(catalogue.queries()["telemetry_prefix_sum"](spark, SF))
    assert "ReadSchema: struct<value:double>" in plan


def test_codec_roundtrip_query(spark):
    rows = catalogue.queries()["codec_roundtrip"](spark, SF).collect()
    assert rows and all(r.same for r in rows)
