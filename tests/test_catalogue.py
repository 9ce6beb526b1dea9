"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from veldspar.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if sql := catalogue.oracle_sql().get(name):
        assert norm(got) == norm(duck.sql(sql).df())
    else:
        assert len(got)


def test_entry_names_its_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "detector" in entry.queries()


def test_pairs_at_the_threshold_are_as_in_sql(spark, tmp_path):
    """0.9 * 52 + 0.2 * 66 is 60, which isn't above 60."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i AS user_id, 'view' AS event_type, 52.0::DOUBLE AS value, '{{"k": ' || i || '}}' AS props
    FROM (SELECT unnest(range(100)) AS i)) TO '{tmp_path}/events.parquet'""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert norm(catalogue.queries()["recipe_pair_contrast"](spark, str(tmp_path)).toPandas()) == norm(con.sql(catalogue.oracle_sql()["recipe_pair_contrast"]).df())
