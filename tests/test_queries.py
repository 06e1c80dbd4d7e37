"""Library queries against their SQL on DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from retentia import registry

SLOW = {"a06", "a07", "a09", "a10", "a11", "a13", "a14", "a14b", "a21", "s08", "s15", "s16", "o05"}  # other names of what is tested anyway
NAMES = [n for n in registry.ORACLE_SQL if n.split("_")[0] not in SLOW]


def canon(df: pd.DataFrame):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return repr(round(float(v), 6) + 0.0)
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, sf, duck, name):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


def test_every_operator_has_a_query():
    sizes = {"s": 17, "p": 31, "j": 18, "a": 39, "w": 11, "o": 6, "u": 4, "c": 17, "t": 26}
    have = {n.split("_")[0] for n in registry.QUERIES}
    assert not [f"{k}{i:02d}" for k, n in sizes.items() for i in range(1, n + 1) if f"{k}{i:02d}" not in have]


@pytest.mark.parametrize("name", ["t12_class_consensus", "t13_pedigree_evaluation", "t18_lineage_peak_labels", "t03_gaussian_picker"])
def test_queries_without_sql_run(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_pushdown_and_pruning(spark, sf):
    plan = registry.QUERIES["a03_total_count_per_entry"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp" in plan
