"""Corpus queries against their SQL."""

from collections import Counter

import pytest

from retentia.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.sql(registry.ORACLE_SQL[name])
    ours = registry.QUERIES[name](spark, sf).select(*found.columns)
    assert Counter(map(tuple, ours.collect())) == Counter(found.fetchall())
