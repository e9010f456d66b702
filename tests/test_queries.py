import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import difference, views

from lodestrata import queries as Q


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    views(con, sf_dir)
    return con


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    assert difference(Q.QUERIES[name](spark, sf_dir), Q.ORACLE_SQL[name], con) == ""


def test_samples_of_any_number_of_rows_equal_their_sql(spark, tmp_path):
    spark.range(0, 200_003, 3).selectExpr("id AS vec_id", "0 AS label", "array(float(id)) AS embedding").limit(66_004).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    views(con, str(tmp_path))
    assert difference(Q.clara_samples(spark, str(tmp_path)), Q.ORACLE_SQL["clara_samples"], con) == ""


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE_SQL])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
