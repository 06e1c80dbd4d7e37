"""Verification of products against their null truncations, and roll-ups along the building-block tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as K
from .parse import SEPARATOR, last_wins

BBS = ["bb1", "bb2", "bb3"]
#: Fixed value: a hub or coupling is flagged below this share of passing products, in per cent.
FLAG_BELOW = 50.0


def key_of(blocks: Column) -> Column:
    return F.array_join(blocks, SEPARATOR)


def positions(columns: list[str] = BBS) -> Column:
    return F.array(*columns)


def has_null(columns: list[str] = BBS) -> Column:
    return F.array_contains(positions(columns), K.NULL)


def truncation_library(rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """key (ordered blocks), rt of rows with a null that hold one or two different blocks, all of them seen in the last
    position of such rows."""
    nulls = rows.where(has_null(columns))
    anchors = nulls.where(F.col(columns[-1]) != K.NULL).agg(F.collect_set(columns[-1]).alias("anchors"))  # one row of block names
    c = nulls.withColumn("class", K.class_of(positions(columns))).crossJoin(F.broadcast(anchors))
    size = F.size("class")
    ok = size.between(1, 2) & (F.size(F.array_distinct("class")) == size) & (F.size(F.array_except("class", "anchors")) == 0)
    return c.where(ok).select(key_of(F.col("class")).alias("key"), F.col("rt").alias("t_rt"))


def abbreviations(columns: list[str] = BBS) -> Column:
    """Keys of all shorter ordered selections of the positions that hold no null."""
    n = len(columns)
    p = positions(columns)
    picks = F.transform(F.sequence(F.lit(1), F.lit(2**n - 2)), lambda m: F.filter(p, lambda x, i: F.getbit(m, i) == 1))
    return F.array_distinct(F.transform(F.filter(picks, lambda a: ~F.array_contains(a, K.NULL)), key_of))


def conflicts_ordered(rows: DataFrame, library: DataFrame, threshold: float, columns: list[str] = BBS) -> DataFrame:
    """columns, conflict: whether a truncation of the row elutes within the threshold of it."""
    keys = rows.select(*columns, "rt", F.explode(abbreviations(columns)).alias("key"))
    hit = keys.join(library, "key").groupBy(*columns).agg(F.max(F.abs(F.col("rt") - F.col("t_rt")) <= threshold).alias("conflict"))
    return rows.select(*columns).join(hit, columns, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def verify(rows: DataFrame, threshold: float, columns: list[str] = BBS) -> DataFrame:
    """columns, rt, success of every row: no truncation within the threshold, and for rows with a null not the all-null
    row's time either."""
    out = rows.join(conflicts_ordered(rows, truncation_library(rows, columns), threshold, columns), columns)
    empty = F.size(K.class_of(positions(columns))) == 0
    bare = rows.where(empty).agg(F.max("rt").alias("null_rt"))  # one row
    near_bare = has_null(columns) & F.coalesce(F.abs(F.col("rt") - F.col("null_rt")) <= threshold, F.lit(False))
    return out.crossJoin(F.broadcast(bare)).select(*columns, "rt", (~F.col("conflict") & ~near_bare).alias("success"))


def conflicts_positional(rows: DataFrame, threshold: float, columns: list[str] = BBS) -> DataFrame:
    """As conflicts_ordered, but against rows with the same blocks in place and nulls elsewhere, the all-null row too."""
    masks = rows.select(*columns, "rt", F.explode(F.array_distinct(K.null_masks(positions(columns), len(columns)))).alias("mask"))
    masks = masks.where(F.col("mask") != positions(columns)).withColumn("key", key_of(F.col("mask")))
    others = rows.select(key_of(positions(columns)).alias("key"), F.col("rt").alias("t_rt"))
    hit = masks.join(others, "key").groupBy(*columns).agg(F.max(F.abs(F.col("rt") - F.col("t_rt")) <= threshold).alias("conflict"))
    return rows.select(*columns).join(hit, columns, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def with_all_rows(library: DataFrame, rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """The truncation library, and the rows whose own key it doesn't hold."""
    own = rows.select(key_of(positions(columns)).alias("key"), F.col("rt").alias("t_rt"))
    return library.unionByName(own.join(library.select("key").distinct(), "key", "left_anti"))


def products(verified: DataFrame, columns: list[str] = BBS) -> DataFrame:
    return verified.where(~has_null(columns))


def tree_paths(verified: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """depth, prefix of every path to a passing product; leaves carry the retention time."""
    n = len(columns)
    p = products(verified, columns).where("success").select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("depth"), positions(columns).alias("p"), "rt")
    leaf = F.when(F.col("depth") == n, F.col("rt"))
    return p.groupBy("depth", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "|").alias("prefix")).agg(F.max(leaf).alias("rt"))


def prefix_stats(verified: DataFrame, cutoff: float, columns: list[str] = BBS) -> DataFrame:
    """Products, passes and failure of every prefix: below the cutoff in per cent, or none passing where it is 0."""
    r = products(verified, columns).rollup(*columns).agg(F.count("*").alias("total"), F.count_if("success").alias("passed"), F.grouping_id().alias("level"))
    pct = 100 * F.col("passed") / F.col("total")
    return r.select(*columns, "level", "total", "passed", (F.col("passed") == 0 if cutoff == 0 else pct < cutoff).alias("failed"))


def pass_summary(verified: DataFrame) -> DataFrame:
    """Per first block, per second block, and per coupling of both (only flagged ones) in one pass by grouping sets."""
    ok = F.count_if("success")
    sets = products(verified).groupingSets([["bb1"], ["bb2"], ["bb1", "bb2"]], "bb1", "bb2").agg(F.grouping_id().alias("g"), F.count("*").alias("total"), ok.alias("passed"))
    pct = 100 * F.col("passed") / F.col("total")
    out = sets.withColumn("scope", F.when(F.col("g") == 1, "cycle_1").when(F.col("g") == 2, "cycle_2").otherwise("cycle_1_and_2")).withColumn("flagged", pct < FLAG_BELOW)
    return out.where((F.col("g") != 0) | F.col("flagged")).select("scope", "bb1", "bb2", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.round(pct, 1).alias("pass_pct"), "flagged")


def library_pass(verified: DataFrame) -> DataFrame:
    p = products(verified).agg(F.count("*").alias("total"), F.count_if("success").alias("passed"))
    return p.withColumn("pass_pct", F.when(F.col("total") > 0, 100 * F.col("passed") / F.col("total")).otherwise(0.0))


def flagged_blocks(verified: DataFrame) -> DataFrame:
    """cycle, bb, flags, couplings, pass_pct, delta (to the library), comment: blocks in any flagged scope."""
    s = pass_summary(verified)
    lib = library_pass(verified).select(F.col("pass_pct").alias("library_pct"))  # one row
    cycles = []
    for cycle, own, other in ((1, "bb1", "bb2"), (2, "bb2", "bb1")):
        single = s.where(F.col("scope") == f"cycle_{cycle}").select(F.col(own).alias("bb"), "flagged", F.col("pass_pct"), "total")
        pair = s.where(F.col("scope") == "cycle_1_and_2").groupBy(F.col(own).alias("bb")).agg(F.count("*").alias("pairs"), F.array_join(F.array_sort(F.collect_list(other)), ";").alias("couplings"))
        both = single.join(pair, "bb", "left").select(F.lit(cycle).alias("cycle"), "bb", "flagged", "pass_pct", "total", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("couplings", F.lit("")).alias("couplings"))
        cycles.append(both)
    every = cycles[0].union(cycles[1]).withColumn("flags", F.col("flagged").cast("int") + F.col("pairs").cast("int")).where("flags > 0")
    out = every.crossJoin(F.broadcast(lib)).withColumn("delta", F.round(F.col("pass_pct") - F.col("library_pct"), 1))
    comment = F.concat_ws(
        " ",
        F.when(F.col("flags") > 1, F.concat(F.lit("flagged "), F.col("flags").cast("string"), F.lit(" times"))),
        F.when(F.col("flagged"), F.lit("most products fail")),
        F.when(F.col("couplings") != "", F.concat(F.lit("with "), "couplings")),
        F.when(F.col("delta") < -10, F.lit("below the library")).when(F.col("delta") > 10, F.lit("above the library")),
    )
    return out.select("cycle", "bb", "flags", "couplings", "pass_pct", "delta", comment.alias("comment"))


def flagged_order(flagged: DataFrame) -> DataFrame:
    return flagged.orderBy(F.desc("flags"), "pass_pct", "cycle", "bb")


def tier_summary(outcomes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per tier (null: all) nodes that passed, failed (looked at, not passed) and were pruned."""
    o = nodes.select("node_id", "tier").join(outcomes.select("node_id", "passed"), "node_id", "left")
    p = F.col("passed")
    return o.rollup("tier").agg(F.count_if(p).alias("pass"), F.count_if(~p).alias("fail"), F.count_if(p.isNull()).alias("pruned"), F.count("*").alias("total"))


def alphabet(rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """position (from 0, N to C), blocks: sorted distinct blocks at each position."""
    p = rows.select(F.posexplode(F.reverse(positions(columns))).alias("position", "bb")).where(F.col("bb") != K.NULL)
    return p.groupBy("position").agg(F.array_sort(F.collect_set("bb")).alias("blocks"))


def building_blocks(rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    return rows.select(F.explode(positions(columns)).alias("bb")).select(F.trim("bb").alias("name")).where((F.col("name") != K.NULL) & (F.col("name") != "")).distinct()


def audit(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """field, value counters of a run. rows: rt_source; verified: success."""
    a = rows.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col("rt_source") == s).alias(f"n_{s}") for s in ("metadata", "pedigree", "peak_pick", "none")))
    b = verified.agg(F.count_if("success").alias("n_verified"), F.count_if(~F.col("success")).alias("n_failed"))
    one = a.crossJoin(b)  # a row each
    return one.unpivot([], one.columns, "field", "value")


def global_index(names: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """name, index: 1-based in order without case, unless a map (name, index) says otherwise. Names are few: one window."""
    out = names.select("name", F.row_number().over(W.orderBy(F.lower("name"), "name")).alias("own"))
    if override is None:
        return out.withColumnRenamed("own", "index")
    given = override.groupBy(F.lower("name").alias("low")).agg(F.min_by("index", "name").alias("given"))
    return out.withColumn("low", F.lower("name")).join(given, "low", "left").select("name", F.coalesce("given", "own").alias("index"))


def cycle_index(rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    p = rows.select(F.posexplode(positions(columns)).alias("level", "name")).where(F.col("name") != K.NULL).distinct()
    return p.withColumn("index", F.row_number().over(W.partitionBy("level").orderBy(F.lower("name"), "name")))


def index_report(index: DataFrame) -> DataFrame:
    """kind, value, times of names (without case) and indices that an index map repeats."""
    names = index.groupBy(F.lower("name").alias("value")).agg(F.count("*").alias("times")).select(F.lit("name").alias("kind"), "value", "times")
    ids = index.groupBy(F.col("index").cast("string").alias("value")).agg(F.count("*").alias("times")).select(F.lit("index").alias("kind"), "value", "times")
    return names.union(ids).where("times > 1")


def pedigree_rt(outcomes: DataFrame) -> DataFrame:
    """key, rt from outcomes (key, rt, passed, ord): the first wins, but a later passing one overrides."""
    order = F.struct(F.col("passed").cast("int"), F.when(F.col("passed"), F.col("ord")).otherwise(-F.col("ord")))
    return outcomes.where(F.col("rt").isNotNull()).groupBy("key").agg(F.max_by("rt", order).alias("rt"))


def outcome_times(outcomes: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """columns, rt, passed of a pedigree's outcomes (node_id, chosen_rt, passed) below the root that found a time, passing or
    not. A class stands for the tuple that holds its blocks at the C terminus and nulls elsewhere; passed is null for it, as only
    whole products pass or fail by the pedigree. Of several outcomes of one tuple a
    passing one wins, then the last by node_id."""
    n = len(columns)
    blocks = F.slice(F.split("node_id", "_"), 2, n)
    placed = outcomes.where("chosen_rt is not null and node_id <> 'C0'").withColumn("_p", F.reverse(K.padded(blocks, n)))
    rows = placed.select(key_of(F.col("_p")).alias("key"), "_p", "passed", "chosen_rt", "node_id")
    order = F.struct(F.col("passed").cast("int"), "node_id")
    best = rows.groupBy("key").agg(F.max_by(F.struct("_p", "passed", "chosen_rt"), order).alias("r"))
    whole = ~F.array_contains("r._p", K.NULL)
    return best.select(*(F.col("r._p")[i].alias(c) for i, c in enumerate(columns)), F.col("r.chosen_rt").alias("rt"), F.when(whole, F.col("r.passed")).alias("passed"))


#: Where a tuple's time comes from, the first that has one.
RT_SOURCES = ("metadata", "pedigree", "peak_pick")


def resolve_times(tuples: DataFrame, sources: dict[str, DataFrame], columns: list[str] = BBS) -> DataFrame:
    """tuples (columns and others) with rt and rt_source: of the given sources (name -> columns, rt; one row a tuple) the
    first of RT_SOURCES that knows the tuple; `none` and no rt where none does."""
    known = [n for n in RT_SOURCES if n in sources]
    for name in known:
        tuples = tuples.join(sources[name].select(*columns, F.col("rt").alias(f"_{name}")), columns, "left")
    rt = F.coalesce(*(F.col(f"_{n}") for n in known), F.lit(None).cast("double"))
    origin = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), n) for n in known), F.lit("none"))
    return tuples.withColumn("rt", rt).withColumn("rt_source", origin).drop(*(f"_{n}" for n in known))


def split_tree(resolved: DataFrame, threshold: float, columns: list[str] = BBS) -> DataFrame:
    """columns, rt, success: tuples with a time, in canonical spelling, the last of each, held against their truncations.
    resolved: columns, rt, row_no."""
    return verify(canonical_rows(resolved.where(F.col("rt").isNotNull()).select("row_no", *columns, "rt"), columns), threshold, columns)


def canonical_rows(rows: DataFrame, columns: list[str] = BBS) -> DataFrame:
    """Rows in canonical spelling, the last of each tuple."""
    known = K.canonical_names(building_blocks(rows, columns))
    for c in columns:
        rows = K.canonical(rows, c, known)
    return last_wins(rows, columns)
