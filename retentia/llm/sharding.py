"""Balanced shards: global prefix sums of byte sizes from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, partitions, written

SHARDS = 24
#: Bytes that a document takes beside its text.
OVERHEAD = 8


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """Contiguous runs of documents, in order of doc_id, of near equal bytes. docs: doc_id, text, others ignored.

    Rows are dealt into ordered range partitions; each partition's total goes into a prefix sum over partitions (as many
    rows as there are partitions), and a running sum within each gives every document its place in the stream of bytes.
    A document goes to the shard in which its middle byte falls, so a shard is off its target by one document at most.
    Only ids, sizes and checksums are moved, never texts.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law ('bytes'), shard (0 to count - 1), slot (gapless from 0 in
    the shard, in order), grown_shard (null: this law has no such promise). Null text: no bytes. Null doc_id: first. Rows
    with one doc_id: ordered by checksum and size, may fall on both sides of a cut. Fewer documents than shards: some
    shards are empty. No documents: no rows.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    order = ["k", "text_crc32", "size", "tie"]
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"),
        (F.length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    dealt = written(rows.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(W.partitionBy()).alias("all_bytes"),
    )
    within = W.partitionBy("part").orderBy(*order)
    placed = (
        dealt.withColumn("end", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("row", F.row_number().over(within))
        .join(F.broadcast(offsets), "part")  # a row for each partition
    )
    shard = F.least(F.lit(count - 1), F.expr(f"{count} * (2 * (bytes_before + end) - size) div (2 * all_bytes)").cast("int"))
    cut = placed.select(*order, "doc_id", (F.col("rows_before") + F.col("row")).alias("place"), shard.alias("shard"))
    cut = written(cut)
    starts = cut.groupBy("shard").agg(F.min("place").alias("first_place"))
    return cut.join(F.broadcast(starts), "shard").select(  # a row for each shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))

