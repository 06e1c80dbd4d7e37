"""Language of web pages by Bayesian fusion of evidence.

posterior(language) ~ host prior * P(text | language)^t * P(declared language | language) * P(address suffix | language).
The text model comes from labelled documents; what declarations and suffixes are worth, and what languages a host has,
is counted over all pages by their likeliest language from the text alone: grouped aggregation, smoothed from the whole
corpus to the suffix to the host.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
#: Labelled documents of each language that the text model is fitted on at most.
SAMPLE_EACH = 500
#: Languages of a model at most; more are an error. Bounds what is broadcast to LANGUAGES x BUCKETS numbers.
LANGUAGES = 1000
#: Hash buckets of byte trigrams.
BUCKETS = 1 << 13
#: Trigrams beyond which more text adds no certainty: neighbours aren't independent.
CERTAIN = 100
#: Pseudo-counts that a host takes from its suffix, and a suffix from the corpus.
HOST_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0
#: Labelled documents that it takes to learn a language; rarer names are not among those that pages can have.
LEAST_DOCUMENTS = 5


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the byte trigrams inside documents, A-Z lower-cased."""
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = C.LOWER[data].astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64) & (BUCKETS - 1)
    at = np.arange(n)
    doc = np.searchsorted(off, at, "right") - 1
    inside = at + 3 <= off[doc + 1]
    return doc[inside], bucket[inside]


def fit_text(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of trigram buckets (languages x BUCKETS), from a bounded sample of each language: its
    SAMPLE_EACH documents of least hash. One pass counts names; a second reads the texts whose hash is low enough to come
    into question, which are few, and ranks these. Raises ValueError beyond LANGUAGES languages."""
    spark = documents.sparkSession
    C.small_batches(spark)
    order = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 40))
    named = documents.select("doc_id", F.lower(F.trim("lang")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> '' and lang <> ''")
    sizes = named.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages have {LEAST_DOCUMENTS} labelled documents")
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    bounds = spark.createDataFrame([(r.lang, int(min(1.0, 2 * SAMPLE_EACH / r.n) * (1 << 40))) for r in sizes], "lang string, bound long")  # LANGUAGES rows at most
    likely = named.withColumn("at", order).join(F.broadcast(bounds), "lang").where(F.col("at") < F.col("bound"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("at", "doc_id", F.xxhash64("text")))  # some 2 * SAMPLE_EACH texts
    rows = likely.withColumn("place", place).where(F.col("place") <= SAMPLE_EACH)

    def count(batches):
        for batch in batches:
            data, off = C.text_buffer(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for i, j in C.chunks(off):
                doc, bucket = trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for lang in set(langs[i:j]):
                    found = np.bincount(bucket[(langs[i:j] == lang)[doc]], minlength=BUCKETS).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([C.packed(found)], pa.binary())], ["lang", "counts"])

    names = [r.lang for r in sizes]
    total = np.zeros((len(names), BUCKETS))
    for r in rows.select("lang", "text").mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[names.index(r.lang)] += C.unpacked(bytes(r.counts), "<i8")[0]
    smooth = total + 0.5
    return names, np.log(smooth / smooth.sum(1, keepdims=True))


def text_evidence(model):
    """Tempered log likelihoods of each page's text."""

    def run(batches):
        table = model.value
        for batch in batches:
            data, off = C.text_buffer(batch.column("text"))
            out = []
            for i, j in C.chunks(off):
                doc, bucket = trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.bincount(doc, minlength=j - i)
                sums = np.stack([np.bincount(doc, weights=row[bucket], minlength=j - i) for row in table], 1)
                out.append(sums * (np.minimum(n, CERTAIN) / np.maximum(n, 1))[:, None])
            x = np.concatenate(out) if out else np.zeros((0, len(table)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(table), dtype=np.int32)), pa.array(x.ravel()))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], [*names, "text_log"])

    return run


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, suffix, declared and the visible text of pages."""
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    text = html
    for pattern in (r"(?is)<(script|style|nav|title)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>", r"&#?\w+;"):
        text = F.regexp_replace(text, pattern, " ")
    host = F.lower(F.regexp_extract(url, r"^\w+://([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"), declared.alias("declared"), text.alias("text"))


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The language of each page. pages: page_id, url, html; documents: doc_id, text, lang (to learn from); others ignored.

    Returns page_id, lang, probability, text_lang (from the text alone; null without text), declared, host, suffix (empty
    where there is none). Null url: no host, whose prior is that of all such pages. Null html: no text and no declaration.
    Null page_id and repeated rows: pages like others. Pages of any length are read whole. Ties: the language first by name.
    Languages of under LEAST_DOCUMENTS labelled documents aren't learnt. No labelled documents: lang null, probability null.
    No pages: no rows.
    """
    spark = pages.sparkSession
    names, table = fit_text(documents)
    parts = page_parts(pages)
    if not names:
        return parts.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", "suffix")
    model = spark.sparkContext.broadcast(table)  # at most LANGUAGES x BUCKETS
    kind = "page_id long, host string, suffix string, declared string, text_log array<double>"
    pages_ = C.written(parts.mapInArrow(text_evidence(model), kind))
    n = len(names)
    name_of = lambda i: F.element_at(F.array(*(F.lit(x) for x in names)), i)
    best = F.array_position("text_log", F.array_max("text_log")).cast("int")
    seen = pages_.withColumn("best", F.when(F.array_max("text_log") < 0, best))
    ones = [F.count_if(F.col("best") == i + 1).cast("double").alias(f"n{i}") for i in range(n)]
    lists = F.array(*(F.col(f"n{i}") for i in range(n)))
    # what languages hosts have: corpus, then suffix, then host, each smoothed with the one before
    by_host = seen.groupBy("suffix", "host").agg(*ones).select("suffix", "host", lists.alias("c"))
    sums = [F.sum(F.col("c")[i]).alias(f"n{i}") for i in range(n)]
    by_suffix = by_host.groupBy("suffix").agg(*sums).select("suffix", lists.alias("s"))
    whole = by_suffix.agg(*(F.sum(F.col("s")[i]).alias(f"n{i}") for i in range(n))).first()
    total = np.array([x or 0.0 for x in whole]) + 1.0
    corpus = F.array(*(F.lit(float(x)) for x in total / total.sum()))
    share = lambda counts, prior, weight: F.zip_with(counts, prior, lambda c, p: (c + weight * p) / (F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) + weight))
    suffix_prior = by_suffix.select("suffix", share(F.col("s"), corpus, F.lit(SUFFIX_WEIGHT)).alias("suffix_share"), "s")
    # P(suffix | language), smoothed towards one that is the same for all
    fit_of_suffix = F.zip_with("s", F.array(*(F.lit(float(x)) for x in total)), lambda a, b: (a + 1.0) / (b + 10.0))
    suffix_prior = suffix_prior.withColumn("suffix_fit", fit_of_suffix)
    host_prior = by_host.join(suffix_prior, "suffix").select("suffix", "host", share(F.col("c"), F.col("suffix_share"), F.lit(HOST_WEIGHT)).alias("prior"), "suffix_fit")
    # P(declared | language), of every declaration; an aggregate whose size decides how it is joined
    said = seen.where("declared <> ''").groupBy("declared").agg(*ones)
    said = said.select("declared", F.zip_with(lists, F.array(*(F.lit(float(x)) for x in total)), lambda a, b: (a + 1.0) / (b + 10.0)).alias("declared_fit"))
    even = F.array(*(F.lit(1.0) for _ in names))
    joined = pages_.join(said, "declared", "left").join(host_prior, ["suffix", "host"])
    log = lambda a: F.transform(a, lambda x: F.log(x))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = plus(plus(F.col("text_log"), log(F.col("prior"))), plus(log(F.coalesce("declared_fit", even)), log(F.col("suffix_fit"))))
    scored = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    at = F.array_position("score", F.col("top")).cast("int")
    spread = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return scored.select(
        "page_id",
        name_of(at).alias("lang"),
        (1 / spread).alias("probability"),
        F.when(F.array_max("text_log") < 0, name_of(best)).alias("text_lang"),
        "declared",
        "host",
        "suffix",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
