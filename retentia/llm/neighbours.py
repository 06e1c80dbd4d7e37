"""Approximate nearest neighbours by inverted lists with an adaptive dimension scan.

Vectors are rotated at random and their columns read in blocks. After each block the partial distance, scaled up, is an
estimate of the whole; a hypothesis test drops a candidate as soon as its distance exceeds the query's current k-th best
with confidence. Survivors are measured exactly, on the original vectors, in double precision. The nearest lists are read
first and give each query the bound that it takes to the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Vectors that centroids are fitted on at most; they also tell how many lists must be probed.
SAMPLE = 8000
#: Lists: the root of the number of vectors, and no more than leave LEAST_IN_LIST of the sample to each.
LEAST_IN_LIST = 30
#: Trial queries from the sample, and the recall that the probed lists must give them.
TRIALS, RECALL = 300, 0.97
#: Vectors of a list, and queries, that meet in one task at once; more are split.
PART, QUERY_BLOCK = 4000, 2000
#: Candidates that are scanned under one bound, which the best of them then tighten, and queries side by side.
STEP, QUERY_STEP = 1000, 200
#: Columns read between tests.
BLOCK = 16
#: The test's strictness: an estimate may be off by EPSILON / sqrt(columns read).
EPSILON = 2.1


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To all centroids, squared, but for what is the same for all."""
        return (self.centroids**2).sum(1) - 2 * x @ self.centroids.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Lists of each vector, nearest first."""
        return np.argsort(self.distances(x), axis=1, kind="stable")


def fit(sample: np.ndarray, lists: int) -> Index:
    """A random rotation, and centroids by k-means on the sample."""
    rng = np.random.default_rng(6)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    distinct = np.unique(sample, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[: min(lists, len(distinct))]].copy()
    for _ in range(8):
        d = (centroids**2).sum(1) - 2 * sample @ centroids.T
        near = d.argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return Index(rotation, centroids)


def lists_to_probe(index: Index, sample: np.ndarray, k: int) -> int:
    """The least number of nearest lists that hold RECALL of the trial queries' k nearest in the sample. Neighbours in a
    sample are farther off than in the whole, and lie in more lists, so the number errs upwards."""
    n = len(sample)
    lists = len(index.centroids)
    trial = sample[np.random.default_rng(7).permutation(n)[:TRIALS]]
    of = index.nearest(sample)
    rank = np.empty((len(trial), lists), np.int64)
    np.put_along_axis(rank, index.order(trial), np.arange(lists)[None, :], 1)
    d = (sample**2).sum(1)[None, :] - 2 * trial @ sample.T
    near = np.argsort(d, axis=1, kind="stable")[:, : k + 1]  # the query itself is one of them
    reached = np.sort(np.take_along_axis(rank, of[near], 1).ravel())
    return int(reached[min(len(reached) - 1, int(np.ceil(RECALL * len(reached))))]) + 1


def scan(queries: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int, bounds: np.ndarray):
    """(query ids, vector ids, distances) of each query's k nearest among the vectors that are no farther than its bound
    (squared), by the adaptive scan; bounds tighten as candidates are found."""
    dim, n = vectors.shape[1], len(queries)
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    rq, rv = queries @ rotation, vectors @ rotation
    bounds = bounds.copy()
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for a in range(0, len(vectors), STEP):
        for i in range(0, n, QUERY_STEP):
            # the first columns of all pairs at once, by a matrix product; then pair by pair what the tests leave
            head = slice(0, BLOCK)
            x, c = rq[i : i + QUERY_STEP, head], rv[a : a + STEP, head]
            near = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :]
            rounding = 1e-12 * near
            near -= 2 * x @ c.T
            limit = bounds[i : i + QUERY_STEP]
            loose = lambda read: (1 + EPSILON / np.sqrt(read)) ** 2 if read < dim else 1 + 1e-9
            read = min(BLOCK, dim)
            keep = (near - rounding) * dim / read <= limit[:, None] * loose(read)
            keep &= query_ids[i : i + QUERY_STEP, None] != ids[None, a : a + STEP]
            q, v = np.nonzero(keep)
            partial = near[q, v]
            q, v = q + i, v + a
            for at in range(BLOCK, dim, BLOCK):
                columns = slice(at, min(at + BLOCK, dim))
                partial += ((rq[q, columns] - rv[v, columns]) ** 2).sum(1)
                keep = partial * dim / columns.stop <= bounds[q] * loose(columns.stop) + 1e-12
                q, v, partial = q[keep], v[keep], partial[keep]
            exact = np.sqrt(((vectors[v] - queries[q]) ** 2).sum(1))
            found = [np.concatenate(x) for x in zip(found, (q, v, exact), strict=True)]
        best = np.lexsort((ids[found[1]], found[2], found[0]))
        q = found[0][best]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        best, rank = best[rank < k], rank[rank < k]
        found = [x[best] for x in found]
        last = rank == k - 1
        bounds[found[0][last]] = np.minimum(bounds[found[0][last]], found[2][last] ** 2 * (1 + 1e-9))
    return query_ids[found[0]], ids[found[1]], found[2]


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Each query's k nearest vectors by Euclidean distance; queries are rows whose vec_id is divisible by `every`,
    candidates are all rows but the query's own.

    vectors: vec_id, embedding (array); others ignored. Centroids are fitted on at most SAMPLE vectors; every vector is in
    a list. Lists beyond PART vectors are scanned in parts, and queries of a list beyond QUERY_BLOCK in blocks, so neither
    copies of one vector nor all queries meet in one task. Returns
    query_id, rank (from 1), vec_id, score; ties: smaller vec_id. Null ids and vectors that are null, zero, of another
    length than most or that hold null or non-finite components take no part. Rows that repeat a vec_id: one of them
    stands for all (the least by components). Fewer than k candidates: all of them. No rows: no rows.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    all_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).where("vec_id is not null and v is not null").where(sound)
    sizes = all_.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    out_kind = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out_kind)
    dim = int(sizes["dim"])
    rows = written(all_.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")))
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).select("v").collect()
    sample = np.array([r.v for r in drawn])
    index = fit(sample, max(1, min(round(n**0.5), len(sample) // LEAST_IN_LIST)))
    lists, probed = len(index.centroids), lists_to_probe(index, sample, k)
    shared = spark.sparkContext.broadcast(index)  # SAMPLE / LEAST_IN_LIST centroids at most, and a rotation

    @F.pandas_udf("int")
    def own_list(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.nearest(np.stack(v.to_numpy())).astype(np.int32))

    placed = written(rows.withColumn("list", own_list("v")))
    held = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # a row for each list
    holds = np.array([held.get(i, 0) for i in range(lists)])
    splits = F.array(*(F.lit(int(max(1, -(-n // PART)))) for n in holds))
    enough = max(20 * k, k + 1)

    @F.pandas_udf("array<int>")
    def asked_lists(v: pd.Series) -> pd.Series:
        """Lists to probe, nearest first: as many as the sample asked for, and on until they hold enough candidates. Those
        that it takes to hold enough are marked by a sign, -1 - list."""
        order = shared.value.order(np.stack(v.to_numpy()))
        size = holds[order]
        first = np.cumsum(size, 1) - size < enough
        wanted = first | (np.arange(lists) < probed)
        return pd.Series([np.where(f, -1 - o, o)[w].astype(np.int32) for o, f, w in zip(order, first, wanted, strict=True)])

    base = placed.select("vec_id", "v", "list", F.pmod(F.xxhash64("vec_id"), splits[F.col("list")]).cast("int").alias("part"))
    mark = F.col("mark")
    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.explode(asked_lists("v")).alias("mark"))
    asked = asked.select("vec_id", "v", F.when(mark < 0, -1 - mark).otherwise(mark).alias("list"), (mark < 0).alias("first"))
    # a list that many queries ask is met by them in blocks, and each block by all parts of the list
    asking = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # a row for each list
    blocks = F.array(*(F.lit(max(1, -(-asking.get(i, 0) // QUERY_BLOCK))) for i in range(lists)))
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), blocks[F.col("list")]).cast("int")
    asked = asked.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), splits[F.col("list")] - 1)))
    base = base.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("list")] - 1)))
    base = base.toDF(*base.columns)  # columns of their own, as queries come from the same table

    def scanned(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if len(queries) == 0 or len(candidates) == 0:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, c = np.stack(queries["v"].to_numpy()), np.stack(candidates["v"].to_numpy())
        found = scan(q, c, queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy(), shared.value.rotation, k, queries["bound"].to_numpy(float))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    def search(queries: DataFrame) -> DataFrame:
        keys = ["list", "part", "block"]
        return queries.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInPandas(scanned, "query_id long, vec_id long, score double")

    # the lists next to a query are read in full; their k-th best is the bound that the others start from
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    near = written(search(asked.where("first").withColumn("bound", F.lit(float("inf")))))
    kth = near.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") * F.col("score") * (1 + 1e-9)).alias("bound"))
    others = asked.where("not first").join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = near.union(search(others))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
