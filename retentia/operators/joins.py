"""Joins of the library's tables. Band conditions always stand beside an equality, so they plan as hash or merge joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..sources.sheets import discard, shared_dir, stored_table


def attach_positions(traces: DataFrame, compounds: DataFrame, variants: list[str] | None = None) -> DataFrame:
    return traces.join(K.isoforms(compounds, variants), "compound_id")


def members_with_traces(members: DataFrame, traces: DataFrame, key: str = "key") -> DataFrame:
    """Every member, with an empty trace where it has none."""
    none = F.array().cast("array<double>")
    return members.join(traces, key, "left").withColumn("rt", F.coalesce("rt", none)).withColumn("y", F.coalesce("y", none))


def parent_gate(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """node_id, threshold of children all of whose parents passed and have a time; the threshold is the latest of these."""
    o = outcomes.select(F.col("node_id").alias("parent_id"), "passed", "chosen_rt")
    ok = F.coalesce(F.col("passed") & F.col("chosen_rt").isNotNull(), F.lit(False))
    gated = edges.join(o, "parent_id", "left").groupBy("child_id").agg(F.every(ok).alias("open"), F.max("chosen_rt").alias("threshold"))
    return gated.where("open").select(F.col("child_id").alias("node_id"), "threshold")


def raise_for_cassettes(gated: DataFrame, nodes: DataFrame, singles: DataFrame) -> DataFrame:
    """Raises thresholds to the latest time of the components of cassettes in a node's class. singles: component, rt."""
    parts = nodes.select("node_id", F.explode("class").alias("bb")).where(K.is_cassette(F.col("bb")))
    parts = parts.select("node_id", F.explode(K.components(F.col("bb"))).alias("component")).join(singles, "component")
    most = parts.groupBy("node_id").agg(F.max("rt").alias("least"))
    return gated.join(most, "node_id", "left").select("node_id", F.greatest("threshold", "least").alias("threshold"))


def resolve_rt(rows: DataFrame, pedigree: DataFrame, picks: DataFrame) -> DataFrame:
    """rows: compound_id, positions key, raw key, meta_rt. The first that there is: the sheet's time, the pedigree's (by
    canonical and then by raw key), the trace's own pick; with the source's name."""
    canon, raw = pedigree.select(F.col("key"), F.col("rt").alias("ped")), pedigree.select(F.col("key").alias("raw_key"), F.col("rt").alias("ped_raw"))
    out = rows.join(canon, "key", "left").join(raw, "raw_key", "left").join(picks.select("compound_id", F.col("rt").alias("pick")), "compound_id", "left")
    ped = F.coalesce("ped", "ped_raw")
    source = F.when(F.col("meta_rt").isNotNull(), "metadata").when(ped.isNotNull(), "pedigree").when(F.col("pick").isNotNull(), "peak_pick").otherwise("none")
    return out.select("compound_id", "key", F.coalesce(F.col("meta_rt"), ped, F.col("pick")).alias("assigned_rt"), source.alias("rt_source"))


def nearest_assignment(peaks: DataFrame, assignments: DataFrame, tolerance: float) -> DataFrame:
    """peaks: compound_id, rt; assignments: compound_id, a_rt, tier, label. Each peak's nearest assignment within the
    tolerance, the higher tier on ties; 'unknown' where there is none."""
    keys = ["compound_id", "rt"]
    close = peaks.select(*keys).distinct().join(assignments, "compound_id").where(F.abs(F.col("rt") - F.col("a_rt")) <= tolerance)
    best = close.groupBy(*keys).agg(F.min_by("label", F.struct(F.abs(F.col("rt") - F.col("a_rt")), -F.col("tier"), F.col("label"))).alias("label"))
    return peaks.join(best, keys, "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def match_by_keys(nodes: DataFrame, compounds: DataFrame, keys: list[str]) -> DataFrame:
    """nodes: node_id, label. A compound for each by the first of its key columns that equals the label."""
    options = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.col(k).alias("label")) for i, k in enumerate(keys)))).alias("o")
    keyed = compounds.select("compound_id", options).select("compound_id", "o.*")
    return nodes.join(keyed, "label").groupBy("node_id").agg(F.min_by("compound_id", F.struct("rank", "compound_id")).alias("compound_id"), F.min("rank").alias("rank"))


def name_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """name (lower case), state: missing on the right or the left, or in both; and whether the left repeats it."""
    a = left.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("times"))
    b = right.select(F.lower("name").alias("name")).distinct().withColumn("there", F.lit(True))
    out = a.join(b, "name", "full_outer")
    state = F.when(F.col("times").isNull(), "extra").when(F.col("there").isNull(), "missing").otherwise("both")
    return out.select("name", state.alias("state"), (F.coalesce("times", F.lit(0)) > 1).alias("repeated"))


def display_index(df: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """idx of a name: exact, else without case; 0 for the null token."""
    exact = index.select(F.col("name").alias(column), F.col("index").alias("exact"))
    loose = index.groupBy(F.lower("name").alias("low")).agg(F.min_by("index", "name").alias("loose"))
    out = df.withColumn("low", F.lower(column)).join(exact, column, "left").join(loose, "low", "left")
    return out.withColumn("idx", F.when(F.col(column) == K.NULL, F.lit(0)).otherwise(F.coalesce("exact", "loose"))).drop("low", "exact", "loose")


def saturation_grid(verified: DataFrame, bb1: str) -> DataFrame:
    """For one hub, bb2 x bb3 in long form with PASS, FAIL or blank. The sides are distinct blocks, a few hundred at most."""
    rows = verified.where(F.col("bb1") == bb1)
    side = lambda c: verified.where(F.col(c) != K.NULL).select(c).distinct()
    cells = side("bb2").crossJoin(side("bb3"))
    mark = rows.select("bb2", "bb3", F.when(F.col("success"), "PASS").otherwise("FAIL").alias("mark"))
    return cells.join(mark, ["bb2", "bb3"], "left").withColumn("mark", F.coalesce("mark", F.lit("")))


def isoform_delta(rows: DataFrame, linear: str, cyclic: str) -> DataFrame:
    """name, linear, cyclic, delta: per name the latest time of each isoform."""
    pick = lambda v: F.max(F.when(F.trim("variant") == v, F.col("rt")))
    out = rows.groupBy("name").agg(pick(linear).alias("linear"), pick(cyclic).alias("cyclic"))
    return out.withColumn("delta", F.col("cyclic") - F.col("linear"))


def broadest_agreement(peaks: DataFrame, tolerance: float) -> DataFrame:
    """peaks: cls, compound_id, rt. Per class the time near which most replicates have a peak (earliest on ties), and each
    replicate's nearest peak to it. The peaks are stored once, as they are read three times."""
    where = f"{shared_dir(peaks.sparkSession)}/{uuid.uuid4().hex}"
    peaks = stored_table(peaks, f"{where}-peaks")
    cell = F.floor(F.col("rt") / tolerance)  # what is within the tolerance lies in the same cell or a neighbour
    places = peaks.select("cls", F.col("rt").alias("pos"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
    near = lambda c: F.abs(F.col("rt") - F.col(c)) <= tolerance
    support = places.join(peaks.withColumn("cell", cell), ["cls", "cell"]).where(near("pos")).groupBy("cls", "pos").agg(F.count_distinct("compound_id").alias("n"))
    center = support.groupBy("cls").agg(F.min_by("pos", F.struct(-F.col("n"), F.col("pos"))).alias("center"))
    best = F.min_by(F.when(near("center"), F.col("rt")), F.struct(~near("center"), F.abs(F.col("rt") - F.col("center")), F.col("rt")))
    out = stored_table(peaks.join(center, "cls").groupBy("cls", "center", "compound_id").agg(best.alias("pick")), where)
    discard(peaks.sparkSession, f"{where}-peaks")
    return out


def agree(a: Column, b: Column) -> Column:
    return F.count_if(a == b)
