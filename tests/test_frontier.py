"""The pedigree grown tier by tier against the one that starts from all members."""

import numpy as np
import pytest

from retentia.functions import tokens as K
from retentia.operators import pedigree as D
from retentia.operators import traces as T

COLUMNS = ["bb1", "bb2", "bb3", "bb4"]
FIND = T.picker("modern", 0.001)


def library(spark, names, center):
    """(rows, traces, members): every member has a trace with a peak at center(its blocks), or none."""
    rows = spark.createDataFrame([tuple(names[(i + j) % len(names)] if (i + j) % 3 else K.NULL for j in range(4)) for i in range(3 * len(names))], ", ".join(f"{c} string" for c in COLUMNS))
    members = D.members(rows, COLUMNS)
    rng = np.random.default_rng(4)
    found = []
    for key in sorted({r.key for r in members.select("key").collect()}):
        blocks = [b for b in key.split("|") if b != K.NULL]
        y = rng.poisson(2, 120).astype(float)
        at = center(blocks)
        if at is not None:
            y[at - 1 : at + 2] += (40, 200, 40)
        found.append((key, np.arange(120.0).tolist(), y.tolist()))
    return rows, spark.createDataFrame(found, "key string, rt array<double>, y array<double>"), members


def plain(outcomes):
    text = lambda v: repr([round(x, 6) if isinstance(x, float) else x for x in v] if isinstance(v, list) else round(v, 6) if isinstance(v, float) else v)
    return sorted(tuple(text(r[c]) for c in D.FIELDS) for r in outcomes.collect())


def later(bad):
    return lambda blocks: None if set(blocks) & bad else 10 + 20 * len(blocks)


@pytest.mark.parametrize("names, bad", [(["A", "B", "C"], {"C"}), (["A", "B", "A-B", "D"], {"D"}), (["A", "B"], set()), (["A", "B"], {"A", "B"})])
def test_grown_pedigree_is_the_whole_one(spark, names, bad):
    rows, traces, members = library(spark, names, later(bad))
    grown = D.evaluate_library(rows, traces, 1.0, FIND, columns=COLUMNS)
    whole = D.evaluate(members, traces, 1.0, lambda rt, y: FIND([(rt, y)])[0])
    assert plain(grown) == plain(whole)
    sizes = {r.tier: r.n for r in D.nodes(members).groupBy("tier").count().toDF("tier", "n").collect()}
    assert {r.tier: r.total for r in D.tier_totals(rows, COLUMNS).collect()} == sizes


def test_pruned_members_are_never_written(spark, monkeypatch):
    rows, traces, members = library(spark, ["A", "B", "C"], later({"C"}))
    written, store = [], D.stored_table

    def recorded(df, path):
        out = store(df, path)
        if "classes" in path:
            written.extend(tuple(r["class"]) for r in out.select("class").collect())
        return out

    monkeypatch.setattr(D, "stored_table", recorded)
    outcomes = D.evaluate_library(rows, traces, 1.0, FIND, columns=COLUMNS)
    assert ("C",) in written and not [c for c in written if len(c) > 1 and "C" in c]
    assert len(written) + 1 == outcomes.count() < D.nodes(members).count()


def test_no_root_and_no_rows(spark):
    rows, traces, _ = library(spark, ["A", "B"], lambda blocks: None)
    assert [r.node_id for r in D.evaluate_library(rows, traces, 1.0, FIND, columns=COLUMNS).collect()] == ["C0"]
    assert D.evaluate_library(rows.limit(0), traces, 1.0, FIND, columns=COLUMNS).count() == 1


def test_a_node_over_batch_borders(spark):
    """Batches of two rows cut every node; its outcome is that of all its rows."""
    rows, traces, members = library(spark, ["A", "B", "C"], later(set()))
    gated = D.replicates(members.where("tier = 2"), traces).withColumn("threshold", D.F.lit(20.0))
    whole = plain(D.consensus_of(gated, FIND, 1.0, 0.001))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert plain(D.consensus_of(gated, FIND, 1.0, 0.001)) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_sample_at_the_edge_of_a_neighbour(spark):
    """The grid's next place and the best place plus a step differ in the last digit; a sample lies 4 sigma from one of them."""
    from retentia.functions import signal as G

    rng = np.random.default_rng(0)
    series = [(np.arange(20.0, 50.0), np.round(5 + 30 * np.exp(-((np.arange(20.0, 50.0) - 35.92) ** 2) / 2) + rng.random(30))) for _ in range(2)]
    baselines = [G.clipped_baseline(y) for _, y in series]
    replicates = spark.createDataFrame([("x", f"k{i}", rt.tolist(), y.tolist()) for i, (rt, y) in enumerate(series)], "cls string, key string, rt array<double>, y array<double>")
    base = spark.createDataFrame([(f"k{i}", mu, r) for i, (mu, _, r) in enumerate(baselines)], "key string, mu double, r double")
    got = D.positions_fit(replicates, base, 1.0, 5.0).first()
    want = G.fit_position(series, baselines, 1.0, 5.0, 49.0, 0.1)
    assert (got.position, got.u, got["info"]) == pytest.approx(want[:3], abs=1e-9)


def test_classes_that_no_positions_hold_are_not_made(spark):
    """Many blocks at two positions and one at the first: pairs and triples that begin with another block can't be placed."""
    many = [f"B{i}" for i in range(40)]
    rows = [(["A"], [[1, None, None]], 1.0)] + [([b], [[None, i + 1, i + 1]], 1.0) for i, b in enumerate(many)]
    singles = spark.createDataFrame(rows, "class array<string>, ranks array<array<int>>, chosen_rt double")
    pairs = D.grown(singles, 2, 3)
    assert pairs.count() == 40 + 40 * 40  # A and a block, or two blocks; never a block and A
    triples = D.grown(pairs.withColumnRenamed("threshold", "chosen_rt"), 3, 3)
    assert triples.count() == 40 * 40 and triples.where("class[0] <> 'A'").isEmpty()
