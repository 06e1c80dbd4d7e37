"""The pedigree of a library: classes of null truncations, evaluated tier by tier, each only past its parents' times."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal as G
from ..functions import tails
from ..functions import tokens as K
from ..sources.sheets import discard, shared_dir, stored_table
from . import joins as J
from .splittree import BBS

#: Fixed names: what is known of a node once it was evaluated.
OUTCOME = (
    "node_id string, passed boolean, insufficient_data boolean, effective_threshold double, score_test_rt double, score_test_rt_se double, "
    "score_test_p_value double, bayesian_pick double, bayesian_pick_posterior double, bayesian_pick_runner_up_posterior double, "
    "bayesian_pick_threshold_margin double, initial_democratic_position double, initial_earliest_picks array<double>, "
    "initial_most_significant_picks array<double>, initial_democratic_picks array<double>, per_rep_score_contribution array<double>, "
    "bayesian_refined_picks array<double>, bayesian_supporting_replicates array<int>, replicates_with_no_signal array<int>, n_replicates int, "
    "n_replicates_with_signal int, chosen_rt double, display_rt double"
)
FIELDS = [f.strip().split(" ")[0] for f in OUTCOME.split(", ")]


def n_to_c(columns: list[str] = BBS) -> Column:
    """Positions from the N terminus: a sheet's columns in reverse."""
    return F.reverse(F.array(*columns))


def members(rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """node_id, kind, tier, class, key (positions N to C, joined), ord of every member of every node.

    All tuples over each position's blocks and the null token; alphabets are dimension tables, so the product is as large
    as the library it spells out. Members are in order of their blocks' ranks, the null token last."""
    n = len(columns)
    sides = []
    for i, c in enumerate(reversed(columns)):
        names = rows.where(F.col(c) != K.NULL).select(F.col(c).alias(f"p{i}")).distinct()
        ranked = names.withColumn(f"r{i}", F.row_number().over(W.orderBy(f"p{i}")))
        bare = rows.sparkSession.range(1).select(F.lit(K.NULL).alias(f"p{i}"), F.lit(2**30).alias(f"r{i}"))
        sides.append(ranked.union(bare))
    cells = reduce(lambda a, b: a.crossJoin(b), sides)
    p = F.array(*(f"p{i}" for i in range(n)))
    cells = cells.select(p.alias("p"), *(f"r{i}" for i in range(n))).withColumn("class", K.class_of(F.col("p")))
    out = cells.select(K.node_id(F.col("p"), n).alias("node_id"), F.when(F.size("class") == n, "compound").otherwise("class").alias("kind"), F.size("class").alias("tier"), "class", F.array_join("p", "|").alias("key"), *(f"r{i}" for i in range(n)))
    order = W.partitionBy("node_id").orderBy(*(f"r{i}" for i in range(n)))
    return out.withColumn("ord", F.row_number().over(order) - 1).select("node_id", "kind", "tier", "class", "key", "ord")


def nodes(members_: DataFrame) -> DataFrame:
    return members_.where("ord = 0").select("node_id", "kind", "tier", "class")


def edges(nodes_: DataFrame) -> DataFrame:
    """parent_id, child_id: a class and what it becomes with one block more, where both exist."""
    up = nodes_.where("tier > 0").select(F.col("node_id").alias("child_id"), F.explode(K.parents(F.col("class"))).alias("pc"))
    up = up.select("child_id", F.array_join("pc", "|").alias("pkey"))
    classes = nodes_.where("kind = 'class'").select(F.col("node_id").alias("parent_id"), F.array_join("class", "|").alias("pkey"))
    return up.join(classes, "pkey").select("parent_id", "child_id")


def replicates(members_: DataFrame, traces: DataFrame) -> DataFrame:
    """Members with their traces (key, rt, y); those without one have empty arrays."""
    return J.members_with_traces(members_, traces)


def _as_row(node_id: str, o: dict) -> dict:
    chosen = G.chosen_rt(o)
    shown = chosen if chosen is not None else next((v for v in o["initial_most_significant_picks"] if v is not None), None)
    o = {"node_id": node_id, **o, "chosen_rt": chosen, "display_rt": shown}
    return {f: o.get(f) for f in FIELDS}


def _traces(rows: pd.DataFrame):
    rows = rows.sort_values("ord")
    return [(np.asarray(rt, float), np.asarray(y, float)) for rt, y in zip(rows["rt"], rows["y"], strict=True)]


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
OUTCOME_FIELDS = pa.schema([(f.strip().split(" ")[0], _ARROW[f.strip().split(" ")[1]]) for f in OUTCOME.split(", ")])


def consensus_of(replicates_: DataFrame, find_many, tolerance: float, alpha: float, min_prominence: float = 0.0, min_pct_area: float = 0.0) -> DataFrame:
    """Outcomes of nodes: agreement of their replicates past the node's threshold. replicates_: node_id, kind, ord, threshold,
    rt, y; find_many: from many traces to the peaks of each.

    Nodes are dealt and sorted by id, so a task settles all nodes of a batch at once; the batch's last node, whose rows may go
    on, waits for the next batch. A node has no more members than there are ways to place its blocks."""

    def settle(rows: pa.Table):
        ids, kinds, thresholds = (rows.column(c).to_pylist() for c in ("node_id", "kind", "threshold"))
        series = [tuple(rows.column(c)[i].values.to_numpy(zero_copy_only=False).astype(float) for c in ("rt", "y")) for i in range(len(ids))]
        found = find_many(series)
        starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        out = []
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            peaks = [G.keep_quality(p, min_prominence, min_pct_area, kinds[a] == "class") for p in found[a:b]]
            out.append(_as_row(ids[a], G.consensus(series[a:b], peaks, float(thresholds[a]), tolerance, alpha)))
        return pa.RecordBatch.from_pylist(out, schema=OUTCOME_FIELDS)

    def run(batches):
        waiting = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            ids = rows.column("node_id").to_pylist()
            cut = ids.index(ids[-1]) if ids else 0
            if cut:
                yield settle(rows.slice(0, cut))
            waiting = rows.slice(cut)
        if waiting is not None and len(waiting):
            yield settle(waiting)

    rows = replicates_.select("node_id", "kind", "ord", "threshold", "rt", "y")
    return rows.repartition("node_id").sortWithinPartitions("node_id", "ord").mapInArrow(run, OUTCOME)


def root_outcome(find):
    """Group function of the root: its trace's most significant peak, without a floor."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rt, y = _traces(rows)[0]
        peaks = find(rt, y)
        best = min(peaks, key=lambda p: (p.p_value, p.rt)).rt if peaks else None
        o = {
            "passed": bool(peaks), "insufficient_data": not peaks, "initial_earliest_picks": [min((p.rt for p in peaks), default=None)],
            "initial_most_significant_picks": [best], "initial_democratic_picks": [None], "bayesian_refined_picks": [None],
            "bayesian_supporting_replicates": [], "replicates_with_no_signal": [], "n_replicates": 1, "n_replicates_with_signal": int(bool(peaks)),
        }
        return pd.DataFrame([_as_row(rows["node_id"].iloc[0], o)])

    return run


def evaluate(members_: DataFrame, traces: DataFrame, tolerance: float, find, alpha: float = 0.001, min_prominence: float = 0.0, min_pct_area: float = 0.0) -> DataFrame:
    """Outcomes (OUTCOME) of all nodes that aren't pruned. traces: key, rt, y.

    Rounds: the root, single blocks, cassettes (where there are any), then tier by tier, N + 2 at most. Members, edges and
    traces are stored once. Each round's nodes are gated by their parents before any trace is joined, so pruned nodes move
    no data, and its outcomes are written to the shared folder."""
    spark = members_.sparkSession
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    members_ = stored_table(members_, f"{folder}-members")
    traces = stored_table(traces.select("key", "rt", "y"), f"{folder}-traces")
    every = nodes(members_)
    links = stored_table(edges(every), f"{folder}-edges")
    cassette = F.exists("class", K.is_cassette)
    seen = every.agg(F.max("tier").alias("top"), F.coalesce(F.max((F.col("tier") == 1) & cassette), F.lit(False)).alias("cassettes")).first()
    root = replicates(members_.where("tier = 0"), traces).groupBy("node_id").applyInPandas(root_outcome(find), OUTCOME)
    outcomes = stored_table(root, f"{folder}-0")
    rounds = [(1, ~cassette), *([(1, cassette)] if seen["cassettes"] else []), *((t, F.lit(True)) for t in range(2, (seen["top"] or 0) + 1))]
    for i, (tier, which) in enumerate(rounds, 1):
        wanted = every.where((F.col("tier") == tier) & which)
        gate = J.parent_gate(links.join(wanted.select(F.col("node_id").alias("child_id")), "child_id"), outcomes)
        if i > 1 and seen["cassettes"]:  # single blocks are known
            singles = every.where((F.col("tier") == 1) & ~cassette).join(outcomes.where("passed and chosen_rt is not null"), "node_id").select(F.col("class")[0].alias("component"), F.col("chosen_rt").alias("rt"))
            gate = J.raise_for_cassettes(gate, wanted.where("kind = 'class'"), singles)
        gated = replicates(members_.join(gate, "node_id"), traces)
        found = consensus_of(gated, lambda traces: [find(rt, y) for rt, y in traces], tolerance, alpha, min_prominence, min_pct_area)
        outcomes = outcomes.unionByName(stored_table(found, f"{folder}-{i}"))
    for name in ("members", "traces", "edges"):  # outcomes stand on their own
        discard(spark, f"{folder}-{name}")
    return outcomes


def block_ranks(rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """block, ranks: its rank in the alphabet of each position from the N terminus, null where that hasn't got it."""
    p = rows.select(F.posexplode(n_to_c(columns)).alias("position", "block")).where(F.col("block") != K.NULL).distinct()
    p = p.withColumn("rank", F.row_number().over(W.partitionBy("position").orderBy("block")))
    return p.groupBy("block").agg(F.array(*(F.max(F.when(F.col("position") == i, F.col("rank"))) for i in range(len(columns)))).alias("ranks"))


def placed(classes: DataFrame, tier: int, n: int) -> DataFrame:
    """The members of classes (class, ranks: of each of its blocks, others kept): ord and key of each way to place the blocks,
    in their order, at positions whose alphabets have them. They come in order of ranks, the null token last, as in members."""
    options = []
    for at in combinations(range(n), tier):
        rank = {p: F.col("ranks")[j][p] for j, p in enumerate(at)}
        name = {p: F.col("class")[j] for j, p in enumerate(at)}
        order = F.array(*(rank.get(p, F.lit(2**30)) for p in range(n))).alias("order")
        member = F.struct(order, F.concat_ws("|", *(name.get(p, F.lit(K.NULL)) for p in range(n))).alias("key"))
        options.append(F.when(reduce(lambda x, y: x & y, (r.isNotNull() for r in rank.values()), F.lit(True)), member))
    every = F.array_sort(F.array_compact(F.array(*options)))
    rest = [c for c in classes.columns if c != "ranks"]
    return classes.select(*rest, F.posexplode(every).alias("ord", "m")).select(*rest, "ord", "m.key")


def last_position(ranks: Column, n: int) -> Column:
    """The position (from 0) of a class's last block when each block takes the first it can have; n where one has none."""
    after = lambda last, r: F.coalesce(*(F.when((last < p) & F.get(r, F.lit(p)).isNotNull(), F.lit(p)) for p in range(n)), F.lit(n))
    return F.aggregate(ranks, F.lit(-1), after)


def grown(survivors: DataFrame, tier: int, n: int) -> DataFrame:
    """class, ranks, threshold of the classes of `tier` blocks that fit into n positions and all of whose classes with one block
    less survived (class, ranks, chosen_rt); the threshold is the latest of these.

    What can't be placed is never made: a survivor that leaves no position behind it isn't lengthened. Else candidates would
    be as many as the blocks to the power of the tier, however short some positions' alphabets are.

    Two survivors make a candidate where one without its first block is the other without its last. Single blocks have nothing
    in common to be joined by: all their pairs are candidates, and are dealt by salt."""
    shared = lambda first: F.array_join(F.slice("class", first, tier - 2), "|") if tier > 2 else F.lit("")
    parts = int(survivors.sparkSession.conf.get("spark.sql.shuffle.partitions")) if tier == 2 else 1
    left = survivors.where(last_position(F.col("ranks"), n) < n - 1).select(shared(2).alias("shared"), F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int").alias("salt"), "class", "ranks")
    right = survivors.select(shared(1).alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"), F.slice("class", -1, 1).alias("last"), F.slice("ranks", -1, 1).alias("last_ranks"))
    made = left.join(right, ["shared", "salt"]).select(F.concat("class", "last").alias("class"), F.concat("ranks", "last_ranks").alias("ranks"))
    made = made.where(last_position(F.col("ranks"), n) < n)
    up = made.select("class", "ranks", F.explode(K.parents(F.col("class"))).alias("parent")).withColumn("parent", F.array_join("parent", "|"))
    known = survivors.select(F.array_join("class", "|").alias("parent"), "chosen_rt")
    met = up.join(known, "parent").groupBy("class", "ranks").agg(F.count("*").alias("n"), F.max("chosen_rt").alias("threshold"))
    return met.where(F.col("n") == F.size(K.parents(F.col("class")))).select("class", "ranks", "threshold")


def evaluate_library(rows: DataFrame, traces: DataFrame, tolerance: float, find_many, alpha: float = 0.001, min_prominence: float = 0.0, min_pct_area: float = 0.0, columns: list[str] = BBS) -> DataFrame:
    """Outcomes (OUTCOME) of all nodes of a library that aren't pruned, without ever spelling out the library: as frequent
    itemsets grow, a tier's classes are made of the classes of the tier before that passed, and only their members are
    placed and joined with traces. rows: the positions' columns; traces: key, rt, y.

    Rounds as in `evaluate`, which gives the same from a list of members; they end with the first tier in which none passes.
    Each round's classes and outcomes are written to the shared folder."""
    spark, n = rows.sparkSession, len(columns)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    temporary = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        temporary.append(f"{folder}-{name}")
        return stored_table(df, temporary[-1])

    blocks, traces = stored(block_ranks(rows, columns), "blocks"), stored(traces.select("key", "rt", "y"), "traces")
    nothing = spark.range(1).select(F.lit("C0").alias("node_id"), F.lit(0).alias("ord"), F.lit("|".join([K.NULL] * n)).alias("key"))
    root = replicates(nothing, traces).groupBy("node_id").applyInPandas(root_outcome(lambda rt, y: find_many([(rt, y)])[0]), OUTCOME)
    outcomes = stored_table(root, f"{folder}-0")
    passed = lambda o: o.where("passed and chosen_rt is not null").select("node_id", "chosen_rt")
    first = passed(outcomes).first()  # the root alone

    def settled(classes: DataFrame, tier: int, name: str, singles: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(outcomes, survivors) of classes (class, ranks, threshold)."""
        node_id = F.concat_ws("_", F.lit(f"{'F' if tier == n else 'C'}{tier}"), F.array_join("class", "_"))
        classes = classes.select(node_id.alias("node_id"), F.lit("compound" if tier == n else "class").alias("kind"), "class", "ranks", "threshold")
        if singles is not None and tier < n:
            raised = J.raise_for_cassettes(classes.select("node_id", "threshold"), classes, singles)
            classes = classes.drop("threshold").join(raised, "node_id")
        classes = stored(classes, f"classes-{name}")
        found = stored_table(consensus_of(replicates(placed(classes, tier, n), traces), find_many, tolerance, alpha, min_prominence, min_pct_area), f"{folder}-{name}")
        return found, stored(passed(found).join(classes, "node_id").select("class", "ranks", "chosen_rt"), f"survivors-{name}")

    if first is not None:
        cassette = K.is_cassette(F.col("block"))
        single = lambda which: blocks.where(which).select(F.array("block").alias("class"), F.array("ranks").alias("ranks"), F.lit(first["chosen_rt"]).alias("threshold"))
        found, survivors = settled(single(~cassette), 1, "1", None)
        outcomes, singles = outcomes.unionByName(found), None
        if not blocks.where(cassette).isEmpty():
            singles = survivors.select(F.col("class")[0].alias("component"), F.col("chosen_rt").alias("rt"))
            found, more = settled(single(cassette), 1, "1c", singles)
            outcomes, survivors = outcomes.unionByName(found), survivors.unionByName(more)
        for tier in range(2, n + 1):
            if survivors.isEmpty():
                break
            found, survivors = settled(grown(survivors, tier, n), tier, str(tier), singles)
            outcomes = outcomes.unionByName(found)
    for path in temporary:  # outcomes stand on their own
        discard(spark, path)
    return outcomes


def tier_totals(rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """tier, total: how many nodes each tier has, from the alphabets alone. A class is counted by the placement that takes
    each block to the first position it can have; blocks of one set of positions are alike, so at most 2**n sets are read."""
    n = len(columns)
    sets = block_ranks(rows, columns).groupBy(F.transform("ranks", lambda r: r.isNotNull()).alias("at")).count().collect()
    ends, totals = {-1: 1}, [(0, 1)]
    for tier in range(1, n + 1):
        further: dict[int, int] = {}
        for last, many in ends.items():
            for s in sets:
                at = next((p for p in range(last + 1, n) if s["at"][p]), None)
                if at is not None:
                    further[at] = further.get(at, 0) + many * s["count"]
        ends = further
        totals.append((tier, sum(ends.values())))
    return rows.sparkSession.createDataFrame([t for t in totals if t[1]], "tier int, total long")


def tier_summary(outcomes: DataFrame, totals: DataFrame) -> DataFrame:
    """Per tier (null: all) nodes that passed, failed and, by the tier's size, were pruned."""
    tier = F.regexp_extract("node_id", r"^[CF](\d+)", 1).cast("int").alias("tier")
    seen = outcomes.groupBy(tier).agg(F.count_if("passed").alias("pass"), F.count_if(~F.col("passed")).alias("fail"))
    whole = totals.join(seen, "tier", "left").na.fill(0, ["pass", "fail"])
    added = [F.sum(c).alias(c) for c in ("pass", "fail")]
    return whole.rollup("tier").agg(*added, (F.sum("total") - F.sum("pass") - F.sum("fail")).alias("pruned"), F.sum("total").alias("total"))


def joint_scores(points: DataFrame, sigma: float) -> DataFrame:
    """points: cls, rep, time, count, mu, r. Score U and information I of a common peak at each whole time within reach of
    a point, by grouped sums alone."""
    mu = F.greatest("mu", F.lit(G.MU_FLOOR))
    var = mu + mu * mu / F.coalesce("r", F.lit(G.NO_DISPERSION))
    reach = F.sequence(F.ceil(F.col("time") - 4 * sigma).cast("int"), F.floor(F.col("time") + 4 * sigma).cast("int"))
    p = points.select("cls", "time", "count", mu.alias("m"), var.alias("v"), F.explode(reach).alias("at"))
    phi = F.exp(-F.pow(F.col("time") - F.col("at"), 2) / (2 * sigma * sigma))
    return p.groupBy("cls", "at").agg(F.sum(phi * (F.col("count") - F.col("m")) / F.col("v")).alias("u"), F.sum(phi * phi / F.col("v")).alias("info"))


def positions_fit(replicates_: DataFrame, baselines: DataFrame, sigma: float, low: float) -> DataFrame:
    """The best common position of each class past `low`: cls, position, u, info, z, p_value, n_replicates.

    replicates_: cls, key, rt, y; baselines: key, mu, r. Scores are grouped sums over a grid, half as fine as the samples
    lie (0.01 to 0.1), so a class may be of any size; a parabola through the best place and its neighbours is kept where
    the score at its top, from the points near it, is higher."""
    spark = replicates_.sparkSession
    half = F.when(F.size("rt") > 1, F.abs(F.get("rt", F.lit(1)) - F.get("rt", F.lit(0))) / 2)
    live = replicates_.where(F.size("rt") > 0)
    ends = live.groupBy("cls").agg(F.max(F.element_at("rt", -1)).alias("high"), F.min(half).alias("half"), F.count("*").alias("n_replicates"))
    step = F.greatest(F.least(F.coalesce("half", F.lit(G.GRID_MOST)), F.lit(G.GRID_MOST)), F.lit(G.GRID_LEAST))
    fits = lambda k: F.lit(low) + F.col("step") * k <= F.col("high")
    last = F.floor((F.col("high") - low) / F.col("step")).cast("int")  # and exactly, whichever way the quotient was rounded
    last = F.when(fits(last + 1), last + 1).when(fits(last), last).otherwise(last - 1)
    ends = ends.where(F.col("high") > low).withColumn("step", step).withColumn("last", last)
    mu = F.greatest("mu", F.lit(G.MU_FLOOR))
    var = mu + mu * mu / F.coalesce("r", F.lit(G.NO_DISPERSION))
    points = live.join(baselines, "key").select("cls", mu.alias("m"), var.alias("v"), F.explode(F.arrays_zip("rt", "y")).alias("p"))
    points = points.select("cls", F.col("p.rt").alias("t"), ((F.col("p.y") - F.col("m")) / F.col("v")).alias("a"), (1 / F.col("v")).alias("b"))
    stored = uuid.uuid4().hex
    points = stored_table(points.join(ends, "cls"), f"{shared_dir(spark)}/{stored}-points")

    def score(places: DataFrame) -> DataFrame:
        """places: points with `at`; u and info by class and `k`."""
        phi = F.exp(-F.pow(F.col("t") - F.col("at"), 2) / (2 * sigma * sigma))
        near = F.abs(F.col("t") - F.col("at")) <= 4 * sigma
        return places.where(near).groupBy("cls", "k").agg(F.sum(phi * F.col("a")).alias("u"), F.sum(phi * phi * F.col("b")).alias("info"))

    first = F.greatest(F.lit(0), F.ceil((F.col("t") - 4 * sigma - low) / F.col("step")).cast("int") - 1)
    until = F.least(F.col("last"), F.floor((F.col("t") + 4 * sigma - low) / F.col("step")).cast("int") + 1)
    place = F.lit(low) + F.col("step") * F.col("k")
    grid = score(points.where(until >= first).withColumn("k", F.explode(F.sequence(first, until))).withColumn("at", place))
    every = ends.select("cls", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("k"))
    grid = every.join(grid, ["cls", "k"], "left").na.fill(0.0, ["u", "info"])
    best = grid.groupBy("cls").agg(F.max_by(F.struct("k", "u", "info"), F.struct("u", -F.col("k"))).alias("b")).select("cls", F.col("b.k").alias("k"), "b.u", "b.info")
    best = stored_table(best.join(ends, "cls").withColumn("at", place), f"{shared_dir(spark)}/{stored}-best")
    # the neighbours lie a step from the best place as it was rounded, which need not be where the grid has its next places
    beside = [F.struct(F.lit(0).alias("k"), F.greatest(F.col("at") - F.col("step"), F.lit(low)).alias("at")), F.struct(F.lit(1).alias("k"), F.least(F.col("at") + F.col("step"), F.col("high")).alias("at"))]
    sides = score(points.join(best.select("cls", F.explode(F.array(*beside)).alias("s")).select("cls", "s.*"), "cls"))
    side = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("u"))), F.lit(0.0))
    best = best.join(sides.groupBy("cls").agg(side(0).alias("left_u"), side(1).alias("right_u")), "cls", "left").na.fill(0.0, ["left_u", "right_u"])
    bend = F.col("left_u") - 2 * F.col("u") + F.col("right_u")
    shift = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("left_u") - F.col("right_u")) / bend))
    inner = (F.greatest(F.col("at") - F.col("step"), F.lit(low)) < F.col("at")) & (F.col("at") < F.least(F.col("at") + F.col("step"), F.col("high"))) & (bend < -1e-12)
    best = best.select("cls", "u", "info", "n_replicates", F.col("at").alias("grid_at"), F.when(inner, F.col("at") + shift * F.col("step")).alias("at"))
    top = score(points.join(best.select("cls", "at"), "cls").withColumn("k", F.lit(0))).select("cls", F.col("u").alias("top_u"), F.col("info").alias("top_info"))
    out = best.join(top, "cls", "left")
    better = F.coalesce(F.col("top_u") > F.col("u"), F.lit(False))
    pick = lambda a, b: F.when(better, F.col(a)).otherwise(F.col(b))
    out = out.select("cls", pick("at", "grid_at").alias("position"), pick("top_u", "u").alias("u"), pick("top_info", "info").alias("info"), "n_replicates")
    z = F.when(F.col("info") > 0, F.col("u") / F.sqrt("info")).otherwise(0.0)
    p = F.when(z > 0, tails.normal_tail(z)).otherwise(0.5)
    out = stored_table(out.select("cls", "position", "u", "info", z.alias("z"), p.alias("p_value"), "n_replicates"), f"{shared_dir(spark)}/{stored}")
    for name in ("points", "best"):
        discard(spark, f"{shared_dir(spark)}/{stored}-{name}")
    return out


def node_status(passed: Column, insufficient: Column, tier: Column, kind: Column) -> Column:
    return F.when(tier == 0, "root").when(passed & (kind == "class"), "passed class").when(passed, "passed compound").when(insufficient, "insufficient data").otherwise("failed")


def visible(nodes_: DataFrame, outcomes: DataFrame, most_tier: int, include_failed: bool) -> DataFrame:
    """Nodes of a drawing: up to a tier, those that passed, and failed ones on demand."""
    o = nodes_.join(outcomes.select("node_id", "passed", "insufficient_data", "chosen_rt"), "node_id")
    shown = o.where(F.col("tier") <= most_tier)
    return shown if include_failed else shown.where("passed")


def product_prominence(nodes_: DataFrame, outcomes: DataFrame, compounds: DataFrame, traces: DataFrame, unit: str = "seconds", stored_unit: str = "seconds") -> DataFrame:
    """compound_id, node_id, chosen_rt (in `unit`), prominence of compounds that passed.

    A node's compound is sought by its shown name, then its storage id, then its primary id (compounds: compound_id, shown,
    primary_id); the chosen time is turned into the traces' unit before their nearest sample is taken. traces:
    compound_id, channel, rt, y."""
    from .parse import in_unit
    from .traces import prominence_at

    good = nodes_.where("kind = 'compound'").join(outcomes.where("passed and chosen_rt is not null").select("node_id", "chosen_rt"), "node_id")
    good = good.select("node_id", F.array_join("class", "-").alias("label"), F.col("chosen_rt").alias("own_rt"))
    matched = J.match_by_keys(good.select("node_id", "label"), compounds, ["shown", "compound_id", "primary_id"]).select("node_id", "compound_id")
    wanted = good.join(matched, "node_id").select("compound_id", "node_id", "own_rt", in_unit(F.col("own_rt"), unit, stored_unit).alias("chosen_rt"))
    found = prominence_at(traces, wanted.select("compound_id", "chosen_rt").distinct())
    return wanted.join(found, ["compound_id", "chosen_rt"]).select("compound_id", "node_id", F.col("own_rt").alias("chosen_rt"), "prominence")


def prominence_summary(nodes_: DataFrame, prominence: DataFrame) -> DataFrame:
    n = nodes_.where("kind = 'compound'").agg(F.count("*").alias("n_compound_nodes"))
    p = prominence.agg(F.avg("prominence").alias("mean"), F.coalesce(F.stddev_samp("prominence"), F.lit(0.0)).alias("std_dev"), F.count("prominence").alias("n"))
    return p.crossJoin(n).withColumn("n_skipped", F.col("n_compound_nodes") - F.col("n"))  # a row each


def ancestors(rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """compound (columns), node_id of the root, of every ordered selection of its blocks, of its cassettes' components as
    single blocks, and of itself."""
    n = len(columns)
    c = rows.where(F.size(K.class_of(F.array(*columns))) == n).withColumn("p", n_to_c(columns))
    picks = F.transform(F.sequence(F.lit(0), F.lit(2**n - 2)), lambda m: F.filter(F.col("p"), lambda x, i: F.getbit(m, i) == 1))
    parts = F.flatten(F.transform(F.filter("p", K.is_cassette), K.components))
    singles = F.transform(F.array_distinct(parts), lambda x: F.array(x))
    classes = F.array_distinct(F.concat(picks, singles))
    ids = F.transform(classes, lambda a: F.when(F.size(a) == 0, "C0").otherwise(F.concat_ws("_", F.concat(F.lit("C"), F.size(a).cast("string")), F.array_join(a, "_"))))
    own = F.array(F.concat_ws("_", F.lit(f"F{n}"), F.array_join("p", "_")))
    return c.select(*columns, F.explode(F.array_distinct(F.concat(ids, own))).alias("node_id"))


def node_table(members_: DataFrame, outcomes: DataFrame, channel: str, alpha: float, tolerance: float, unit: str, isoform: str = "All", columns: list[str] = BBS) -> DataFrame:
    """A row for every node, pruned ones too (evaluated = 0): what was found, its members, its own blocks by cycle (the
    first cycle is the C terminus) and the settings."""
    n = len(columns)
    listed = members_.groupBy("node_id", "kind", "tier").agg(F.first("class").alias("class"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda x: F.replace(x["key"], F.lit("|"), F.lit("-"))), "|").alias("members"))
    o = listed.join(outcomes.withColumn("evaluated", F.lit(1)), "node_id", "left")
    padded = K.padded(F.col("class"), n)
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    return o.select(
        F.col("node_id").alias("id"),
        F.array_join("class", "-").alias("label"),
        "tier",
        "kind",
        flag("evaluated"),
        flag("passed"),
        flag("insufficient_data"),
        "chosen_rt",
        "effective_threshold",
        "score_test_rt",
        F.col("score_test_p_value").alias("score_test_p"),
        "bayesian_pick",
        F.col("bayesian_pick_posterior").alias("bayesian_posterior"),
        flag("n_replicates"),
        flag("n_replicates_with_signal"),
        "members",
        *(padded[n - i].alias(f"bb_cycle_{i}") for i in range(1, n + 1)),
        F.lit(channel).alias("channel"),
        F.lit(alpha).alias("alpha"),
        F.lit(tolerance).alias("tolerance"),
        F.lit(unit).alias("time_unit"),
        F.lit(isoform).alias("isoform"),
    )


def lineage(ancestors_: DataFrame, members_: DataFrame, outcomes: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """A panel for each compound and ancestor that the pedigree has; `evaluated` is false for pruned ones."""
    sizes = members_.groupBy("node_id").agg(F.first("kind").alias("kind"), F.first("tier").alias("tier"), F.first("class").alias("class"), F.count("*").cast("int").alias("n_replicates"))
    o = outcomes.drop("n_replicates").withColumn("evaluated", F.lit(True))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    found = ancestors_.join(sizes, "node_id").join(o, "node_id", "left")
    rest = [c for c in outcomes.columns if c not in ("node_id", "passed", "insufficient_data", "n_replicates", "n_replicates_with_signal")]
    return found.select(*columns, "node_id", "kind", "tier", "class", "n_replicates", flag("evaluated"), flag("passed"), flag("insufficient_data"), F.coalesce("n_replicates_with_signal", F.lit(0)).alias("n_replicates_with_signal"), *rest)


def lineage_table(panels: DataFrame, channel: str, alpha: float, tolerance: float, unit: str, columns: list[str] = BBS) -> DataFrame:
    """The nineteen columns of a lineage file."""
    return panels.select(
        F.concat_ws("-", *columns).alias("compound_id"),
        F.lit(channel).alias("channel"),
        "tier",
        F.array_join("class", "|").alias("class_bbs"),
        "node_id",
        "n_replicates",
        *(F.col(c).cast("int").alias(c) for c in ("evaluated", "passed", "insufficient_data")),
        "effective_threshold",
        "score_test_rt",
        "score_test_rt_se",
        "score_test_p_value",
        "bayesian_pick",
        "bayesian_pick_posterior",
        "n_replicates_with_signal",
        F.lit(alpha).alias("alpha"),
        F.lit(tolerance).alias("tolerance"),
        F.lit(unit).alias("time_unit"),
    )


def lineage_failures(rows: DataFrame, nodes_: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """Rows without a lineage, with the reason: a position without a block, or no node of the pedigree."""
    n = len(columns)
    own = rows.select(*columns, K.node_id(n_to_c(columns), n).alias("node_id"))
    found = own.join(nodes_.select("node_id", F.lit(True).alias("there")), "node_id", "left")
    reason = F.when(~K.is_full(F.array(*columns), n), "no block at a position").when(F.col("there").isNull(), "not in the pedigree")
    return found.withColumn("error", reason).where("error is not null").select(*columns, "error")


#: Times by which peaks are named: the kernel's order, or the labels' own.
CHOSEN = {"kernel": ("bayesian_pick", "score_test_rt"), "label": ("score_test_rt", "bayesian_pick")}


def peak_labels(peaks: DataFrame, panels: DataFrame, tolerance: float, order: str = "kernel", min_prominence: float = 0.0, min_pct_area: float = 0.0, unit: str = "seconds", stored_unit: str = "seconds") -> DataFrame:
    """What each peak is by its nearest ancestor, and then the peaks of enough prominence and share of the area, or that are
    a null truncation.

    peaks: compound_id, rt, prominence, pct_area, others kept; panels: compound_id, tier, class, kind and the outcome's
    times, in `unit`; tolerance in `unit`."""
    from .parse import in_unit

    name = F.array_join("class", "-")
    said = F.when(F.col("kind") == "compound", F.concat(F.lit("intended product ("), name, F.lit(")"))).when(F.col("tier") == 0, "root (all null)").otherwise(F.concat(F.lit("null truncation ("), name, F.lit(")")))
    pick = F.get(F.filter("initial_most_significant_picks", lambda x: x.isNotNull()), F.lit(0))
    chosen = F.coalesce(*(F.col(c) for c in CHOSEN[order]), pick)
    a = panels.select("compound_id", in_unit(chosen, unit, stored_unit).alias("a_rt"), "tier", said.alias("label")).where("a_rt is not null")
    scale = {("seconds", "minutes"): 1 / 60, ("minutes", "seconds"): 60.0}.get((unit, stored_unit), 1.0)
    labelled = J.nearest_assignment(peaks, a, tolerance * scale)
    good = (F.col("prominence") >= min_prominence) & (F.col("pct_area") >= min_pct_area)
    return labelled.where(good | F.col("label").startswith("null truncation"))
