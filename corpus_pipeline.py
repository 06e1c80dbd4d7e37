"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Toxic documents go, one document of each near-duplicate group stays, passages that stand earlier in the corpus are cut
out of the later documents, documents that hold a benchmark item go, and what is left is packed into token windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from retentia.llm import common, decontamination, minhash, packing, suffix_array, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic. Rows with null or empty text, or a null id, are scored like
    others. No usable labels: all rows stay. No documents: no rows."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8) the rows with the smallest id; a null id is
    below all others. Rows without words stay, and so do exact repeats of a row that stays. No documents: no rows."""
    return minhash.keep_one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a string of 100 bytes covers which starts earlier too. Null text becomes empty;
    documents of which only blanks are left go. No documents: no rows."""
    return suffix_array.drop_repeated_passages(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 80 % with their tiles. Rows with null or empty text stay. No items: all rows
    stay. No documents: no rows."""
    return decontamination.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its place in a sequence of 4096 tokens. Null text: its closing id alone. Repeated ids:
    a document each. No documents: no rows."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_near_duplicate),
    ("suffix_array_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]
#: SQL can't express fitted models, tilings and tokenizers; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents; what stages write stays in the shared folder."""
    docs, shared = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}-{i}")
        docs = spark.read.parquet(f"{shared}-{i}")
    return docs
