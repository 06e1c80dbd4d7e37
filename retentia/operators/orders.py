"""Ranks, pages and order statistics of whole tables, without a sort in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sheets import discard, shared_dir, stored_table

SPLITTERS = 256
#: Splitters are looked up in two steps, first every so many-th.
STEP = 16
#: Values of a group that are ranked in one task when narrowing has come down to them.
FEW = 50_000
BINS = 4096


def _ranges(df: DataFrame, key: Column, splitters: int) -> DataFrame:
    """df with _key and _range, the number of splitters up to the key. Splitters are the key of least hash of each of so many
    slots: the same whenever they are drawn again, a uniform sample of distinct keys, and no more than a row a slot is moved."""
    keyed = df.withColumn("_key", key)
    least = F.min(F.struct(F.xxhash64("_key", F.lit(1)), F.col("_key").alias("_key")))["_key"]
    some = keyed.groupBy(F.pmod(F.xxhash64("_key"), F.lit(splitters))).agg(least.alias("_cut"))
    cuts = some.agg(F.array_sort(F.collect_list("_cut")).alias("_cuts")).withColumn("_coarse", F.filter("_cuts", lambda _, i: i % STEP == 0))
    up_to = lambda c: F.size(F.filter(c, lambda x: x <= F.col("_key")))
    ranged = keyed.crossJoin(F.broadcast(cuts)).withColumn("_from", (up_to("_coarse") - 1) * STEP)  # one row
    at = F.when(F.col("_from") < 0, 0).otherwise(F.col("_from") + up_to(F.slice("_cuts", F.greatest(F.col("_from"), F.lit(0)) + 1, F.lit(STEP))))
    return ranged.withColumn("_range", at).drop("_cuts", "_coarse", "_from")


def _before(ranged: DataFrame) -> DataFrame:
    """_range, _before, _n: rows in the ranges before, and in the range."""
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    return sizes.select("_range", "_n", F.coalesce(before, F.lit(0)).alias("_before"))


def ranked(df: DataFrame, keys: list[Column], name: str = "place", splitters: int = SPLITTERS) -> DataFrame:
    """df with each row's place (from 1) in the order of the keys, nulls first. Rows are ranked in ranges of keys, and a range
    begins after as many places as the ranges before it have rows. Keys together should tell rows apart: rows of equal keys get
    their places in any order, in one task."""
    ranged = _ranges(df, F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))), splitters)
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    placed = ranged.withColumn("_own", own).join(F.broadcast(_before(ranged)), "_range")
    return placed.select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def page(df: DataFrame, key: str, offset: int, limit: int, splitters: int = SPLITTERS) -> DataFrame:
    """One page in order of the key (unique; nulls first), with the number of all rows beside each as total.

    Ranges of keys are counted, and only rows of the ranges that hold the page are ranked and sorted: a deep page costs what the
    first one does. Beyond the last row a page is empty."""
    ranged = _ranges(df, F.struct(F.col(key).alias("k0")), splitters)
    sizes = _before(ranged).withColumn("total", F.sum("_n").over(Window.partitionBy()))  # a row for each range
    held = sizes.where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset))
    some = ranged.join(F.broadcast(held), "_range")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    found = some.withColumn("_place", place).where((F.col("_place") > offset) & (F.col("_place") <= offset + limit))
    return found.orderBy("_place").select(*df.columns, "total")


def medians(df: DataFrame, value: str, by: str, few: int = FEW, bins: int = BINS) -> DataFrame:
    """by, median: the exact median of each group's values (the mean of the middle two of an even number), null for a group
    without values. Null values don't count, infinite ones do, NaN is the greatest. Null is a group like others.

    By narrowing: each round counts the values of an interval in equal bins, all groups in one grouped count, and goes on with the
    ends of the bin that holds the rank wanted. A bin of one value is an answer however often it stands; what is left of a
    group when no interval holds more than a few values is ranked. State is two rows a group, written each round."""
    spark, root = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    kept = lambda frame, name: stored_table(frame, f"{root}/{name}")
    values = kept(df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")), "values")
    v, lo, hi, finite = F.col("v"), F.col("lo"), F.col("hi"), F.abs("v") < float("inf")
    ends = values.groupBy("g").agg(F.count("v").alias("n"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"))
    # The value wanted is the k-th (from 1) of the n in the interval from lo to hi; the first interval is the whole group.
    middle = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    first = ends.where("n > 0").select("g", F.explode(middle).alias("rank"), "n", "lo", "hi", F.lit(True).alias("whole"))
    wanted, n_round = kept(first.withColumn("k", F.col("rank")), "round0"), 0
    while wanted.where((F.col("n") > few) & (lo < hi) | F.col("whole")).limit(1).count():
        n_round += 1
        intervals = wanted.select(F.col("g").alias("h"), "lo", "hi", "whole").distinct()
        inside = values.join(intervals, v.isNotNull() & F.col("g").eqNullSafe(F.col("h")) & (F.col("whole") | v.between(lo, hi)))
        width = hi / bins - lo / bins
        at = F.when(F.isnan(v), bins + 1).when(~finite, F.when(v > 0, bins).otherwise(-1)).when(v == lo, 0).when(v == hi, bins - 1)
        at = at.otherwise(F.when(width > 0, F.least(F.floor((v - lo) / width), F.lit(bins - 1))).otherwise(0))
        counted = inside.groupBy("h", "lo", "hi", at.cast("int").alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        w = Window.partitionBy("h", "lo", "hi").orderBy("bin")  # at most as many rows as there are bins
        counted = counted.select("h", F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "m", "least", "most", (F.sum("m").over(w) - F.col("m")).alias("below"))
        same = F.col("g").eqNullSafe(F.col("h")) & lo.eqNullSafe(F.col("lo_")) & hi.eqNullSafe(F.col("hi_"))
        chosen = wanted.join(counted, same & (F.col("k") > F.col("below")) & (F.col("k") <= F.col("below") + F.col("m")))
        chosen = chosen.select("g", "rank", F.col("m").alias("n"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.lit(False).alias("whole"), (F.col("k") - F.col("below")).alias("k"))
        wanted = kept(chosen, f"round{n_round}")
    settled = wanted.where("lo = hi").select("g", "rank", F.col("lo").alias("v"))
    left = wanted.where("lo < hi").withColumnRenamed("g", "h")
    close = values.join(left, F.col("g").eqNullSafe(F.col("h")) & v.between(lo, hi))
    close = close.withColumn("i", F.row_number().over(Window.partitionBy("h", "rank").orderBy("v"))).where("i = k")
    found = settled.union(close.select("g", "rank", "v")).groupBy(F.col("g").alias("h")).agg(F.avg("v").alias("median"))
    out = ends.join(found, F.col("g").eqNullSafe(F.col("h")), "left").select(F.col("g").alias(by), "median")
    out = kept(out, "medians")
    for name in ["values", *(f"round{i}" for i in range(n_round + 1))]:
        discard(spark, f"{root}/{name}")
    return out
