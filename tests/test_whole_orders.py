"""Orders and set differences that no row cap or id subset cuts."""

from retentia import registry
from retentia.operators import search as S


def test_tree_order_places_every_row(spark):
    names = ["AgxNull", *(f"B{i}" for i in range(1, 8)), "b3"]
    rows = [(a, b, c) for a in names for b in names for c in names]
    got = S.tree_order(spark.createDataFrame(rows, "bb1 string, bb2 string, bb3 string"), ["bb1", "bb2", "bb3"]).collect()
    key = lambda r: [(x != "AgxNull", x.lower()) for x in r[:3]]
    assert sorted(r.place for r in got) == list(range(1, len(rows) + 1))
    assert [key(r) for r in sorted(got, key=lambda r: r.place)] == sorted(map(key, rows))


def test_queries_keep_all_rows(spark, sf):
    q = lambda name: registry.QUERIES[name](spark, sf).collect()
    assert len(q("o01b_null_first_sort_whole")) == len(q("t21_sequence_verification")) > 60
    assert len(q("o05b_flagged_order_whole")) == len(q("a29_flagged_blocks")) > 0


def test_missing_extra(spark):
    df = lambda *names: spark.createDataFrame([(n,) for n in names], "x string")
    got = S.missing_extra(df("A", "b", "B", "c"), df("a", "d", "D"), "x").collect()
    assert sorted(map(tuple, got)) == [("b", "missing"), ("c", "missing"), ("d", "extra")]


def test_flagged_blocks_are_verified_once(spark, sf):
    plan = registry.QUERIES["o05b_flagged_order_whole"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan
