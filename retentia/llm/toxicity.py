"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over words and word beginnings; each model also gets the
probabilities of the categories before it. In training these are out-of-fold predictions, so that a later model learns
from probabilities as good as those it will see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .linear import logistic, sigmoid

U64 = np.uint64
#: Labelled documents that a model is fitted on at most: of each value of the last category.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 1500, 2500
#: Words and beginnings that models weigh, chosen by their association with each category.
FEATURES = 1200
FOLDS = 5
#: Bytes of a word's beginning that count as a feature of their own.
BEGINNINGS = (4, 5)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) of every word and word beginning; A-Z lower-cased, words of letters and digits."""
    data = C.LOWER[data]
    start, end, woff = C.word_bounds(data, off, C.MARKS)
    prefix = C.Prefix(C.BYTE_VALUES[data])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    docs, found = [doc], [prefix.of(start, end)]
    for n in BEGINNINGS:
        long = end - start > n
        docs.append(doc[long])
        found.append(C.splitmix(prefix.of(start[long], start[long] + n) + U64(n)))
    return np.concatenate(docs), np.concatenate(found)


def sampled_features(batches):
    """The distinct feature hashes of each document."""
    for batch in batches:
        data, off = C.text_buffer(batch.column("text"))
        out = []
        for i, j in C.chunks(off):
            doc, h = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            keep = C.changes(doc, h)
            at, h = np.searchsorted(doc[keep], np.arange(j - i + 1)), h[keep].view(np.int64)
            out += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.int64()))], [*names, "features"])


@dataclass
class Chain:
    categories: list[str]
    vocabulary: np.ndarray  # sorted feature hashes
    weights: list[np.ndarray]  # per category: features, earlier probabilities, intercept

    def probabilities(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """From (document, place in the vocabulary) pairs without repeats."""
        out = np.zeros((n, len(self.categories)))
        m = len(self.vocabulary)
        for c, w in enumerate(self.weights):
            z = np.bincount(doc, weights=w[feature], minlength=n) if len(doc) else np.zeros(n)
            out[:, c] = sigmoid(z + out[:, :c] @ w[m : m + c] + w[-1])
        return out


def association(positive: Column, seen: Column, y: int, n: int) -> Column:
    """G statistic of a feature with a 0/1 category, from its counts in the positive and in all of n documents, y positive."""
    positive, seen = positive.cast("double"), seen.cast("double")
    cells = [(positive, y, seen), (y - positive, y, n - seen), (seen - positive, n - y, seen), (n - y - seen + positive, n - y, n - seen)]
    total = F.lit(0.0)
    for count, row, column in cells:
        total = total + F.when((count > 0) & (column > 0), count * F.log(count * n / (column * row))).otherwise(0.0) if row else total
    return 2 * total


def chosen_features(sample: DataFrame, names: list[str]) -> np.ndarray:
    """The FEATURES features (hashes, ascending) most associated with the categories, the best of each by turns, of those that
    three documents have. Features are counted in Spark; FEATURES of each category reach the driver."""
    totals = sample.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    counts = sample.select(*names, F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("seen"), *(F.sum(n).alias(n) for n in names))
    counts = C.written(counts.where("seen >= 3"))
    turns: dict[int, int] = {}
    for n in names:
        g = association(F.col(n), F.col("seen"), totals[n], totals["n"])
        best = counts.select("feature", F.round(g, 9).alias("g")).orderBy(F.desc("g"), "feature").limit(FEATURES).collect()
        for rank, r in enumerate(best):
            turns[r.feature] = min(rank, turns.get(r.feature, rank))
    best = sorted(turns, key=lambda f: (turns[f], f))[:FEATURES]
    return np.sort(np.array(best, np.int64).view(U64))


def known_features(vocabulary: np.ndarray):
    """A mapInArrow function: each document's places in the vocabulary."""

    def run(batches):
        for batch in batches:
            out = [np.flatnonzero(np.isin(vocabulary, np.array(f.as_py(), np.int64).view(U64))) for f in batch.column("features")]
            names = [n for n in batch.schema.names if n != "features"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.int64()))], [*names, "places"])

    return run


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str]) -> Chain:
    """categories: name -> SQL condition over `labels`, in the order of the chain; the last one balances the sample.

    Fitted on at most SAMPLE_POSITIVE + SAMPLE_NEGATIVE labelled documents, those of least hash of the id, one text of each id
    (the least). What reaches the driver is bounded by that and by FEATURES, whatever the texts' lengths and repeats."""
    names = list(categories)
    marked = labels.select("doc_id", *(F.expr(f"cast({c} as int)").alias(n) for n, c in categories.items())).dropna()
    marked = marked.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    order = F.xxhash64("doc_id", F.lit(11))
    last = F.col(names[-1])
    chosen = marked.where(last == 1).orderBy(order, "doc_id").limit(SAMPLE_POSITIVE).union(marked.where(last == 0).orderBy(order, "doc_id").limit(SAMPLE_NEGATIVE))
    rows_in = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows_in = rows_in.groupBy(F.col("doc_id").cast("long").alias("doc_id"), *names).agg(F.min("text").alias("text"))  # an id's texts: the least
    kind = ", ".join(["doc_id long", *(f"{n} int" for n in names), "features array<long>"])
    sample = C.written(rows_in.mapInArrow(sampled_features, kind))
    vocabulary = chosen_features(sample, names)
    rows = sorted(sample.mapInArrow(known_features(vocabulary), kind.replace("features", "places")).collect(), key=lambda r: r.doc_id)  # FEATURES places a row at most
    if not rows:
        return Chain(names, np.zeros(0, U64), [np.append(np.zeros(c), -30.0) for c in range(len(names))])
    y = np.array([[r[n] for n in names] for r in rows], float)
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        x[i, r.places] = 1
    fold = np.arange(len(rows)) % FOLDS
    weights, earlier = [], np.zeros((len(rows), 0))
    for c in range(len(names)):
        with_earlier = np.hstack([x, earlier.astype(np.float32)])
        weights.append(logistic(with_earlier, y[:, c]))
        if c + 1 < len(names):
            p = np.zeros(len(rows))
            for f in range(FOLDS):
                w = logistic(with_earlier[fold != f], y[fold != f, c])
                p[fold == f] = sigmoid(with_earlier[fold == f] @ w[:-1] + w[-1])
            earlier = np.hstack([earlier, p[:, None]])
    return Chain(names, vocabulary, weights)


def score(chain):
    def run(batches):
        model: Chain = chain.value
        m = len(model.vocabulary)
        for batch in batches:
            data, off = C.text_buffer(batch.column("text"))
            found = []
            for i, j in C.chunks(off):
                doc, h = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if m and len(h):
                    at = np.minimum(np.searchsorted(model.vocabulary, h), m - 1)
                    hit = model.vocabulary[at] == h
                    pair = np.unique(doc[hit] * m + at[hit])
                    doc, at = pair // m, pair % m
                else:
                    doc = at = np.zeros(0, np.int64)
                found.append(model.probabilities(doc, at, j - i))
            p = np.concatenate(found) if found else np.zeros((0, len(model.categories)))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(p[:, c]) for c in range(p.shape[1]))], [*names, *(f"p_{n}" for n in model.categories)])

    return run


#: In the order of the chain: text that is no use, then abuse. `labels` marks these two.
CATEGORIES = {"junk": "quality = 0", "toxic": "toxic = 1"}


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """Probabilities of each category for every document, and whether the last one has 0.5 or more.

    docs: doc_id, text; labels: doc_id and the columns that the conditions read; other columns are ignored. Returns doc_id,
    p_<category>..., <last category> (boolean). Null or empty text: what the intercepts say. Null doc_id and repeated rows:
    scored like others. Texts of any length are read whole. Labels with nulls are not used; of several for one id a
    category holds if any says so. Without usable labels every probability is next to 0. No documents: no rows.
    """
    found = row_toxicity(docs, labels, categories)
    return found.select(F.nullif("k", F.lit(C.NULL_ID)).alias("doc_id"), *found.columns[2:])


def row_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """As toxicity, with k and tag, which tell rows apart, in place of doc_id."""
    spark = docs.sparkSession
    C.small_batches(spark)
    categories = categories or CATEGORIES
    chain = spark.sparkContext.broadcast(fit(docs, labels, categories))  # FEATURES weights
    kind = ", ".join(["k long, tag long", *(f"p_{n} double" for n in categories)])
    scored = C.row_keyed(docs).mapInArrow(score(chain), kind)
    last = list(categories)[-1]
    return scored.withColumn(last, F.col(f"p_{last}") >= 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A table like documents without the rows that the chain finds toxic. Other rows of the same id stay, with null text
    too; rows that repeat id and text go together. No usable labels: all rows. No documents: no rows."""
    return C.picked_rows(docs, row_toxicity(docs, labels).where("toxic").select("k", "tag").distinct(), "left_anti")
