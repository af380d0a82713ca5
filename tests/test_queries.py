"""Every registered query with SQL against DuckDB, on the smallest driver tables, if they are at hand."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from twinsieve.plans.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)


def rows_of(frame, columns):
    return sorted(tuple(map(same, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows_of(got, columns) == rows_of(expected, columns)


def test_profiled_detection(spark):
    rows = QUERIES["profiled_detection"](spark, SF).toPandas()
    assert (rows.sim >= 0.9).all() and (rows.id1 < rows.id2).all() and not rows.duplicated(["id1", "id2"]).any()
