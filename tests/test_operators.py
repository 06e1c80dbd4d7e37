"""Operators on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.functions import signal as G
from retentia.operators import joins as J
from retentia.operators import metrics as M
from retentia.operators import parse as P
from retentia.operators import pedigree as D
from retentia.operators import search as S
from retentia.operators import splittree as T
from retentia.operators import traces as R
from retentia.sources import sheets

NULL = "AgxNull"


def cells(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_no int, cell string")


def test_parsing(spark):
    items = P.split_items(F.col("cell"), (",", ";", ":"))
    got = [r.items for r in cells(spark, "10:5;6, 20:7;8", "", " ; ,").select(items.alias("items")).collect()]
    assert got == [["10", "5", "6", "20", "7", "8"], [], []]
    two = cells(spark, "T1;C1:C2,T2;C1:C2", "T1,C1,T2", "").select(P.group_items(items, 3).alias("three"), P.group_items(items, 2).alias("two")).collect()
    assert [len(x) for x in two[0].three] == [3, 3]
    assert two[1].two is None and two[2].three is None


def test_cleaning(spark):
    rows = spark.createDataFrame([("a", "v", "2:1;x, 1:-4;2, -1:3;3, z:1;1"), ("b", "v", "q:1;1"), ("c", " ", "1:1;1"), (None, "v", "1:1;1")], "id string, variant string, cell string")
    got = {r.id: r for r in P.ingested(rows, P.SheetOptions()).collect()}
    assert [(p.time, {c.channel: c["count"] for c in p.counts}) for p in got["a"].points] == [(1.0, {"Count": 0.0, "Scaled": 2.0}), (2.0, {"Count": 1.0})]
    assert [got[k].reject_reason for k in ("a", "b", "c", None)] == [None, "no_valid_points", "missing_variant", "missing_id"]


def test_search(spark):
    rows = [("c1", "DVal", "DPhe", "100.5", "2020-01-01"), ("c2", "dval", "DVal", "abc", "2020-02-01"), ("c3", "DVal", "Leu", "0", "2020-01-15"), ("c4", "Leu", "DPhe", None, "2019-12-31"), ("c5", "PreDValX", "DPhe", "50", "2021-01-01")]
    df = spark.createDataFrame(rows, "id string, bb1 string, bb2 string, mass string, run string")
    ids = lambda *c: sorted(r.id for r in S.search(df, list(c)).collect())
    assert ids(S.Condition("bb1", "=", "DVal")) == ["c1", "c2", "c3"]
    assert ids(S.Condition("bb1", "=", "DVal", case_sensitive=True)) == ["c1", "c3"]
    assert ids(S.Condition("mass", "<", "60")) == ["c3", "c5"]
    assert ids(S.Condition("bb1", "contains", "val"), S.Condition("run", "<", "2020-01-10", "date")) == ["c1"]
    assert ids(S.Condition("bb1", "=", "Leu"), S.Condition("bb2", "=", "Leu", combiner="OR"), S.Condition("mass", ">=", "0")) == ["c3"]
    assert S.search(df, []).count() == 0
    with pytest.raises(ValueError, match="no field"):
        S.search(df, [S.Condition("nothing", "=", "1")])


def test_metrics(spark):
    p = spark.createDataFrame([("c1", "Count", 1.0, 10.0), ("c1", "Count", 2.0, 20.0), ("c2", "Count", 1.0, 40.0)], "compound_id string, channel string, time double, count double")
    r = M.total_count_per_entry(p).first()
    assert (r["mean"], r["std_dev"], r["n"]) == (35.0, pytest.approx(50**0.5), 2)
    h = {x.bin: x.n for x in M.histogram(M.entry_totals(p), "total", 2).collect()}
    assert h == {0: 1, 1: 1}
    assert M.channel_stats(p.limit(0), "count").count() == 0


def rows_of(spark, table):
    return spark.createDataFrame([(*k, float(v), i) for i, (k, v) in enumerate(table.items())], "bb1 string, bb2 string, bb3 string, rt double, row_no long")


def test_truncation_check(spark):
    n = NULL
    rows = rows_of(spark, {(n, n, n): 10, ("A", n, n): 12, ("A", "B", n): 12, (n, n, "A"): 12, (n, n, "B"): 30, ("A", "B", "C"): 12.1, ("A", "B", "D"): 15})
    ok = {(r.bb1, r.bb2, r.bb3): r.success for r in T.verify(rows, 0.5).collect()}
    assert not ok["A", "B", "C"] and ok["A", "B", "D"]
    assert not ok[n, n, n]
    paths = {(r.depth, r.prefix) for r in T.tree_paths(T.verify(rows, 0.5)).collect()}
    assert paths == {(1, "A"), (2, "A|B"), (3, "A|B|D")}


def test_index_file(spark):
    good = spark.createDataFrame([("LA03", 30, True), ("LA18", 31, True)], "name string, index long, ok boolean")
    bad = good.union(spark.createDataFrame([("DPhe", None, False)], good.schema))
    assert sheets.usable_bb_index(good).count() == 2 and sheets.usable_bb_index(bad).count() == 0
    diff = {r.name: r.state for r in J.name_differences(spark.createDataFrame([("LA03",), ("LA18",), ("DPhe",)], "name string"), spark.createDataFrame([("la03",)], "name string")).collect()}
    assert diff == {"la03": "both", "la18": "missing", "dphe": "missing"}


def test_peak_labels(spark):
    peaks = spark.createDataFrame([("x", 20.5, 9.0, 60.0), ("x", 30.2, 1.0, 30.0), ("x", 99.0, 9.0, 10.0), ("x", 21.0, 1.0, 1.0)], "compound_id string, rt double, prominence double, pct_area double")
    rows = [("x", 1, ["A"], "class", 20.0, 24.0, [20.0]), ("x", 3, ["A", "B", "C"], "compound", None, 30.0, [None]), ("x", 0, [], "class", None, None, [None, 99.0])]
    panels = spark.createDataFrame(rows, "compound_id string, tier int, class array<string>, kind string, bayesian_pick double, score_test_rt double, initial_most_significant_picks array<double>")
    got = lambda **o: {r.rt: r.label for r in D.peak_labels(peaks, panels, 1.5, **o).collect()}
    assert got() == {20.5: "null truncation (A)", 30.2: "intended product (A-B-C)", 99.0: "root (all null)", 21.0: "null truncation (A)"}
    # a poor peak stays if it is a null truncation
    assert got(min_prominence=5.0, min_pct_area=5.0) == {20.5: "null truncation (A)", 99.0: "root (all null)", 21.0: "null truncation (A)"}
    assert got(order="label")[20.5] == "unknown"


def test_filters_do_not_split_cells_again(spark):
    rows = cells(spark, "1:2;3").selectExpr("'a' AS id", "'v' AS variant", "cell")
    plan = P.good(P.ingested(rows, P.SheetOptions())).where("groups is not null")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "split(" in line]


def test_pruned_nodes_are_listed(spark):
    centers = {"": 5, "A": 10, "B": None, "AA": 15, "AB": 15, "BA": 15, "BB": 15}
    members, outcomes = pedigree(spark, centers)
    o = spark.createDataFrame([tuple(r) for r in outcomes.values()], D.OUTCOME)
    rows = {r.id: r for r in D.node_table(members, o, "Count", 0.001, 0.5, "seconds", columns=["bb1", "bb2"]).collect()}
    assert len(rows) == 7 and (rows["F2_A_B"].evaluated, rows["F2_A_B"].bb_cycle_1, rows["F2_A_B"].bb_cycle_2) == (0, "B", "A")
    assert (rows["C1_A"].evaluated, rows["C1_A"].passed, rows["C1_A"].members) == (1, 1, "A-AgxNull|AgxNull-A")


def pedigree(spark, centers):
    """Two blocks at two positions; a trace of a spike on 3 for each tuple, flat where the center is None."""
    n = NULL
    rows = spark.createDataFrame([(a, b) for a in ("A", "B", n) for b in ("A", "B", n)], "bb1 string, bb2 string")
    t = np.arange(0, 60, 0.25)

    def y(c):
        return np.full(len(t), 3.0) if c is None else np.round(3 + 150 * np.exp(-((t - c) ** 2) / 0.5))

    keys = [(a, b) for a in ("A", "B", n) for b in ("A", "B", n)]
    traces = [("|".join(k), t.tolist(), y(centers["".join(x for x in k if x != n)]).tolist()) for k in keys]
    df = spark.createDataFrame(traces, "key string, rt array<double>, y array<double>")
    members = D.members(rows, ["bb1", "bb2"])
    out = D.evaluate(members, df, 0.5, lambda rt, y: G.pick_peaks(rt, y, 0.001))
    return members, {r.node_id: r for r in out.collect()}


def test_pedigree_prunes(spark):
    members, o = pedigree(spark, {"": 5, "A": 10, "B": None, "AA": 15, "AB": 15, "BA": 15, "BB": 15})
    assert D.nodes(members).count() == 7
    assert o["C0"].passed and o["C1_A"].passed and not o["C1_B"].passed
    assert o["F2_A_A"].passed and not {"F2_A_B", "F2_B_A", "F2_B_B"} & set(o)


def test_pedigree_orders_times(spark):
    _, o = pedigree(spark, {"": 5, "A": 10, "B": 20, "AA": 15, "AB": 15, "BA": 15, "BB": 25})
    assert {k: o[k].passed for k in ("F2_A_A", "F2_A_B", "F2_B_A", "F2_B_B")} == {"F2_A_A": True, "F2_A_B": False, "F2_B_A": False, "F2_B_B": True}
    assert o["C1_A"].chosen_rt == pytest.approx(10, abs=0.3)


def test_times_come_from_the_first_source_that_knows(spark):
    bbs = "bb1 string, bb2 string, bb3 string"
    tuples = spark.createDataFrame([("A", "B", str(i), i) for i in range(4)], bbs + ", row_no int")
    known = lambda *of: spark.createDataFrame([("A", "B", str(i), float(rt)) for i, rt in of], bbs + ", rt double")
    sources = {"peak_pick": known((0, 1), (1, 2), (2, 3)), "pedigree": known((0, 10), (1, 20)), "metadata": known((0, 100))}
    found = {r.bb3: (r.rt, r.rt_source) for r in T.resolve_times(tuples, sources).collect()}
    assert found == {"0": (100.0, "metadata"), "1": (20.0, "pedigree"), "2": (3.0, "peak_pick"), "3": (None, "none")}
    assert {r.rt_source for r in T.resolve_times(tuples, {}).collect()} == {"none"}


def test_scan_keeps_skipped_rows_once(spark):
    rows = [(1, "x", "v", "5:1;2, 3:4;y"), (2, None, "v", "1:1;1"), (3, "z", "v", ""), (4, "q", "v", None)]
    out = P.scan(P.ingested(spark.createDataFrame(rows, "row_no int, id string, variant string, cell string"), P.SheetOptions())).collect()
    assert sorted((r.row_no, r.place, r.time, r.channel, r["count"]) for r in out if r.row_no == 1) == [(1, 0, 3.0, "Count", 4.0), (1, 1, 5.0, "Count", 1.0), (1, 1, 5.0, "Scaled", 2.0)]
    assert sorted((r.row_no, r.reject_reason, r.place) for r in out if r.row_no > 1) == [(2, "missing_id", None), (3, "missing_chromatogram", None), (4, "missing_chromatogram", None)]


def test_analysis_is_the_peaks_with_their_baseline(spark):
    y = [1.0, 2.0, 1.0, 60.0, 2.0, 1.0, 2.0, 1.0, 1.0, 2.0, 1.0, 1.0]
    traces = spark.createDataFrame([("a", "Count", [float(i) for i in range(12)], y), ("b", "Count", [0.0, 1.0], [1.0, 2.0])], "compound_id string, channel string, rt array<double>, y array<double>")
    found, peaks = R.analyse(traces).collect(), R.pick(traces).collect()
    base = R.baselines(traces).where("compound_id = 'a'").first()
    assert [r[:11] for r in found] == [tuple(r) for r in peaks] and len(peaks) == 1
    assert (found[0].baseline_mu, found[0].baseline_sigma) == (base.baseline_mu, base.baseline_sigma)
    assert [r.compound_id for r in R.failures(traces).collect()] == ["b"]
    assert R.analyse(traces.where("1 = 0")).count() == 0


def test_times_of_pedigree_outcomes(spark):
    rows = [("C0", 3.0, True), ("C1_B4", 8.0, True), ("C2_B4_B2", 9.0, False), ("F3_B4_B2_B7", 12.0, True), ("F3_B4_B2_B8", 13.0, False), ("F3_B4_B2_B9", None, False)]
    got = T.outcome_times(spark.createDataFrame(rows, "node_id string, chosen_rt double, passed boolean")).collect()
    n = "AgxNull"
    assert sorted(map(tuple, got)) == sorted([("B4", n, n, 8.0, None), ("B2", "B4", n, 9.0, None), ("B7", "B2", "B4", 12.0, True), ("B8", "B2", "B4", 13.0, False)])
    assert T.outcome_times(spark.createDataFrame([], "node_id string, chosen_rt double, passed boolean")).count() == 0


def test_scan_orders_points_of_one_time_by_their_counts(spark):
    rows = [(1, "a", "linear", "9:4;7, 9:2;5, 3:1;1, 9:2;x, 9:x;1, 9:2;3")]
    out = P.scan(P.ingested(spark.createDataFrame(rows, "row_no int, id string, variant string, cell string"), P.SheetOptions())).collect()
    got = {(r.place, r.time): {} for r in out}
    for r in out:
        got[r.place, r.time][r.channel] = r["count"]
    assert got == {(0, 3.0): {"Count": 1, "Scaled": 1}, (1, 9.0): {"Count": 2}, (2, 9.0): {"Count": 2, "Scaled": 3}, (3, 9.0): {"Count": 2, "Scaled": 5}, (4, 9.0): {"Count": 4, "Scaled": 7}, (5, 9.0): {"Scaled": 1}}
