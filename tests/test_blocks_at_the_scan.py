"""Joins on a tuple's blocks put no filter on the rows of lineitem."""

import pytest

from retentia.operators import splittree as S
from retentia.plans import library as L
from retentia.plans import q_splittree as Q
from retentia.sources import sheets


def filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Filter " in x and "split(" in x]


def test_join_of_tuples(spark, sf):
    rows = L.rt_rows(spark, sf)
    assert filters(rows.join(rows.groupBy(*S.BBS).count(), S.BBS)) == []
    assert [f.nullable for f in rows.select(*S.BBS).schema] == [False] * 3


def test_times_of_the_split_tree_job(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(sheets, "stored_table", lambda df, path: made.append(df) or df)
    times = Q.job_times(spark, sf)
    assert filters(made[0]) == []
    assert sorted(times.columns) == ["bb1", "bb2", "bb3", "row_no", "rt", "rt_source"]


@pytest.mark.parametrize("key, separator", [("B1|AgxNull|B22", r"\|"), ("B1,AgxNull,B22", ",")])
def test_blocks_of_a_key(spark, key, separator):
    row = spark.createDataFrame([(key,)], "key string").select(*L.own_blocks("key", separator)).first()
    assert tuple(row) == ("B1", "AgxNull", "B22")
