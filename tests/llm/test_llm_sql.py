"""Every query of the subpackage that has SQL against DuckDB."""

import duckdb
import pytest

from tests.test_queries import SF, TABLES, canonical
from weft.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert canonical(registry.queries()[name](spark, SF).toPandas()) == canonical(db.execute(registry.oracle_sql()[name]).df())
