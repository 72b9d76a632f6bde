"""Every registered query against its SQL, over whole small tables; a listing of those without."""

import os

import pandas as pd
import pytest
import test_without_sql

from tidewatch.plans.oracle import ORACLE
from tidewatch.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(small, t)}.parquet'")
    return con


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "-" if v is None or v is pd.NaT or (isinstance(v, float) and pd.isna(v)) else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, duck, name):
    got, expected = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_queries_without_sql_have_tests():
    without = sorted(set(QUERIES) - set(ORACLE))
    assert without == ["q_adaptive_models", "q_forest_grid", "q_forest_stacking", "q_isolation_forest", "q_principal_components", "q_sqli_detect", "q_sqli_differences", "q_sqli_explain", "q_sqli_models", "q_stacking", "q_text_forest"]
    assert set(without) <= {f.removeprefix("test_") for f in dir(test_without_sql)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
