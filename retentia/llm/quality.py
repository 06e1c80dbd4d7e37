"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank: sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2, which
takes time linear in a document's features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .linear import sigmoid

U64 = np.uint64
#: Labelled documents that a model is fitted on at most, of each quality.
SAMPLE_EACH = 1800
#: Hash buckets of words, and rank of the interactions.
BUCKETS, RANK = 1024, 8
STATISTICS = (
    "log words", "log bytes a word", "distinct words", "most frequent word", "repeated neighbours", "upper case", "digits",
    "punctuation", "other marks", "bytes beyond ASCII", "lines a word", "log characters (metadata)",
)
WIDE = BUCKETS + len(STATISTICS)


def kinds() -> dict[str, np.ndarray]:
    of = lambda test: np.array([test(chr(b)) and b < 128 for b in range(256)])
    return {
        "upper": of(str.isupper),
        "digit": of(str.isdigit),
        "point": of(lambda c: c in ".,;:!?'\"-()"),
        "mark": of(lambda c: not c.isalnum() and not c.isspace() and c not in ".,;:!?'\"-()"),
        "high": np.arange(256) >= 128,
        "line": np.arange(256) == 10,
    }


KINDS = kinds()


def per_document(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(values, dtype=np.float64))
    return sums[off[1:]] - sums[off[:-1]]


def inputs(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Dense inputs, documents x WIDE: word frequencies by bucket, scaled, then statistics."""
    n = len(off) - 1
    h, start, end, woff = C.word_hashes(C.LOWER[data], off)
    words, size = np.diff(woff), np.diff(off)
    doc = np.repeat(np.arange(n), words)
    some, bytes_ = np.maximum(words, 1), np.maximum(size, 1)
    bucket = (h % U64(BUCKETS)).astype(np.int64)
    x = np.zeros((n, WIDE), np.float32)
    x[:, :BUCKETS] = np.sqrt(np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / some[:, None])
    order = np.lexsort((h, doc))
    new = C.changes(doc[order], h[order])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, doc[order][at], count)
    same = np.zeros(len(h))
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    share = {k: per_document(m[data], off) / bytes_ for k, m in KINDS.items()}
    x[:, BUCKETS:] = np.stack(
        [
            np.log1p(words) / 8,
            np.log1p(per_document((end - start).astype(float), woff) / some),
            np.bincount(doc[order][at], minlength=n) / some,
            most / some,
            np.bincount(doc, weights=same, minlength=n) / some,
            share["upper"] * 3,
            share["digit"] * 3,
            share["point"] * 3,
            share["mark"] * 3,
            share["high"],
            np.minimum(share["line"] * bytes_ / some, 1) * 2,
            np.log1p(np.maximum(n_chars, 0)) / 10,
        ],
        1,
    )
    return x


def batch_inputs(batch: pa.RecordBatch):
    data, off = C.text_buffer(batch.column("text"))
    n_chars = np.nan_to_num(batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float))
    for i, j in C.chunks(off):
        for a in range(i, j, 512):  # dense rows
            b = min(a + 512, j)
            yield inputs(data[off[a] : off[b]], off[a : b + 1] - off[a], n_chars[a:b])


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * (s * s - (x * x) @ (self.v * self.v)).sum(1)


def fit_machine(x: np.ndarray, y: np.ndarray, l2: float = 2e-4, epochs: int = 60, batch: int = 128) -> FactorisationMachine:
    """Adam on the log loss, classes weighted alike."""
    rng = np.random.default_rng(3)
    n, m = x.shape
    model = FactorisationMachine(0.0, np.zeros(m, np.float32), (0.03 * rng.standard_normal((m, RANK))).astype(np.float32))
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)).astype(np.float32)
    params = [np.zeros(1, np.float32), model.w, model.v]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
            xb = x[rows]
            model.bias = float(params[0][0])
            s = xb @ model.v
            e = (sigmoid(model.raw(xb)) - y[rows]).astype(np.float32) * weight[rows] / len(rows)
            grads = [np.array([e.sum()]), xb.T @ e + l2 * model.w, xb.T @ (e[:, None] * s) - ((xb * xb).T @ e)[:, None] * model.v + l2 * model.v]
            t += 1
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    model.bias = float(params[0][0])
    return model


def held_out() -> F.Column:
    """Documents that labels are never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def plain(docs: DataFrame) -> DataFrame:
    n_chars = F.coalesce(F.col("n_chars").cast("long"), F.lit(0)) if "n_chars" in docs.columns else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame) -> FactorisationMachine | None:
    """On at most SAMPLE_EACH documents of each quality, not held out, of least hash of the id; of several rows of an id the
    least by text."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    order = F.xxhash64("doc_id", F.lit(8))
    parts = [marked.where(F.col("quality") == q).orderBy(order, "doc_id").limit(SAMPLE_EACH) for q in (0, 1)]
    rows_in = plain(docs).join(F.broadcast(parts[0].union(parts[1])), "doc_id")
    rows_in = rows_in.groupBy("doc_id", "quality").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "n_chars")).alias("d")).select("doc_id", "quality", "d.*")  # a row for each id

    def run(batches):
        for batch in batches:
            blobs = [x[i].tobytes() for x in batch_inputs(batch) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(blobs, pa.binary())], ["doc_id", "quality", "x"])

    rows = sorted(rows_in.mapInArrow(run, "doc_id long, quality int, x binary").collect(), key=lambda r: (r.doc_id, r.x))
    y = np.array([r.quality for r in rows], float)
    if len(rows) < 2 or y.min() == y.max():
        return None
    return fit_machine(np.stack([np.frombuffer(r.x, np.float32) for r in rows]), y)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every document's quality, as labels.quality marks it (1: good).

    docs: doc_id, text, n_chars (metadata, may be missing); labels: doc_id, quality; others ignored. Labels of held-out
    documents are never read. Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5). Null text: empty,
    scored like others by its statistics. Null n_chars: 0. Null doc_id: not held out, unless its checksum says so.
    Repeated rows: scored each. Texts of any length are read whole. Of several labels for one id the least counts. Without
    labels of both qualities every score is 0.5. No documents: no rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))  # BUCKETS * (RANK + 1) numbers

    def run(batches):
        for batch in batches:
            p = [sigmoid(model.value.raw(x)) if model.value else np.full(len(x), 0.5) for x in batch_inputs(batch)]
            p = np.concatenate(p).astype(float) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = plain(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
