import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import difference, views

from lodestrata.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    views(con, sf_dir)
    assert difference(Q.QUERIES[name](spark, sf_dir), Q.ORACLE_SQL[name], con) == ""
