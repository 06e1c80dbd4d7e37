"""Pages, ranks and medians against plain sorting."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from retentia.operators import orders as R


def frame(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n long").repartition(5)


def shuffled(n):
    keys = [f"c{i:05d}" for i in range(n)] + ["", "Z", "é", None]
    random.Random(3).shuffle(keys)
    return keys


@pytest.mark.parametrize("offset, limit", [(0, 7), (500, 40), (1001, 10), (1004, 5), (9999, 5), (3, 0)])
def test_pages(spark, offset, limit):
    keys = shuffled(1000)
    order = sorted(keys, key=lambda k: (k is not None, (k or "").encode()))
    got = R.page(frame(spark, keys), "key", offset, limit, splitters=50).collect()
    assert [r.key for r in got] == order[offset : offset + limit]
    assert all(r.total == 1004 for r in got)


def test_a_page_is_not_sorted_in_one_task(spark):
    plan = R.page(frame(spark, shuffled(1000)), "key", 900, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Offset" not in plan and "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_ranks_with_ties_and_nulls(spark):
    rows = [(random.Random(i).choice([None, 1, 1, 1, 2, 3]), i) for i in range(400)]
    got = R.ranked(spark.createDataFrame(rows, "a int, b int"), [-F.col("a"), F.col("b")], splitters=20).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == order
    assert sorted(r.place for r in got) == list(range(1, 401))
    one = R.ranked(spark.createDataFrame([(1, 1)] * 30, "a int, b int"), [F.col("a")])
    assert sorted(r.place for r in one.collect()) == list(range(1, 31))
    assert R.ranked(spark.createDataFrame([], "a int"), [F.col("a")]).count() == 0


def test_medians(spark):
    rng = random.Random(5)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(501)],
        "even": [rng.random() for _ in range(400)],
        "wide": [math.exp(rng.uniform(-600, 600)) for _ in range(300)],
        "ties": [1.0] * 300 + [2.0] * 299 + [1e308, -1e308],
        "two": [1.0, 4.0],
        "one": [7.5],
        "infinite": [float("inf"), float("-inf"), 3.0, float("inf")],
        None: [1.0, 2.0, 9.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    got = {r.g: r.median for r in R.medians(spark.createDataFrame(rows, "g string, v double"), "v", "g", few=8, bins=256).collect()}
    assert got.pop("none") is None
    assert got == pytest.approx({g: statistics.median(vs) for g, vs in groups.items()}, rel=1e-15)
    assert R.medians(spark.createDataFrame([], "g string, v double"), "v", "g").count() == 0
