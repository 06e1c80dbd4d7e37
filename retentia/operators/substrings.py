"""A trigram index of a column's values, for searches of text within them.

Values are told apart without case. The index is two tables: the distinct values, and postings (trigram, values), sorted by
trigram, so that a search reads the row groups of its own trigrams alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Postings of a trigram are intersected if they are at most so many times those of the rarest; commoner ones cut off little.
WORTH = 8
#: Characters whose trigrams a task sorts at once; a longer value stands alone.
CHARACTERS = 500_000
VALUES, POSTINGS = "low string, at long", "gram string, at array<long>"


@dataclass(frozen=True)
class TrigramIndex:
    values: str
    postings: str


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def postings_of(texts: list[str], at: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(trigrams, offsets, numbers): the distinct trigrams of some texts, each with the numbers of the texts that hold it."""
    size = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    letters = np.flatnonzero(np.bincount(code, minlength=1))
    n, m = len(texts), len(letters)
    if m**3 * n >= 1 << 63:  # a trigram and a text no longer are one number; those of a single text always are
        for part in (slice(None, n // 2), slice(n // 2, None)):
            yield from postings_of(texts[part], at[part])
        return
    rank = np.zeros(letters.max(initial=0) + 1, np.int64)
    rank[letters] = np.arange(m)
    code, text = rank[code], np.repeat(np.arange(n), size)
    pairs = (((code[:-2] * m + code[1:-1]) * m + code[2:]) * n + text[2:])[text[2:] == text[:-2]]  # a trigram begins and ends in one text
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    triple = pairs // n
    first = np.flatnonzero(np.append(True, triple[1:] != triple[:-1])[: len(pairs)])
    names = triple[first]
    chars = letters[np.stack([names // m**2, names // m % m, names % m], 1)] if m else np.zeros((0, 3))
    joined = chars.astype("<u4").tobytes().decode("utf-32-le")
    yield [joined[i : i + 3] for i in range(0, len(joined), 3)], np.append(first, len(pairs)), at[pairs - triple * n]


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of low, at rows, some rows at a time."""
    for batch in batches:
        low, at = batch.column("low"), batch.column("at").to_numpy()
        ends = np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHARACTERS, "right")))
            for grams, offsets, numbers in postings_of(low.slice(i, j - i).to_pylist(), at[i:j]):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(numbers, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), lists], ["gram", "at"])
            i = j


def build(df: DataFrame, column: str, folder: str) -> TrigramIndex:
    """Indexes the values of a column, as text; null is none. Values shorter than three characters have no postings.

    Postings are stored before they are dealt into ranges, whose splitters take a pass of their own over them."""
    index, read = TrigramIndex(f"{folder}-values", f"{folder}-postings"), df.sparkSession.read
    low = df.select(F.lower(F.col(column).cast("string")).alias("low")).where("low is not null").distinct()
    low.select("low", F.xxhash64("low").alias("at")).write.parquet(index.values)
    read.schema(VALUES).parquet(index.values).mapInArrow(postings, POSTINGS).write.parquet(f"{folder}-unsorted")
    unsorted = read.schema(POSTINGS).parquet(f"{folder}-unsorted")
    unsorted.repartitionByRange("gram", F.col("at")[0]).sortWithinPartitions("gram").write.parquet(index.postings)  # a common trigram takes several ranges
    return index


def proposed(spark: SparkSession, index: TrigramIndex, grams: list[str]) -> DataFrame:
    """__at: hashes of values that hold the rarest of some trigrams; a hash that values share is proposed for all of them."""
    found = spark.read.schema(POSTINGS).parquet(index.postings).where(F.col("gram").isin(grams))
    sizes = {r["gram"]: r["n"] for r in found.groupBy("gram").agg(F.sum(F.size("at")).alias("n")).collect()}  # one row a trigram of the text
    if len(sizes) < len(grams):
        return found.select(F.explode("at").alias("__at")).where("1 = 0")
    chosen = [g for g in grams if sizes[g] <= WORTH * min(sizes.values())]
    each = found.where(F.col("gram").isin(chosen)).select("gram", F.explode("at").alias("__at"))
    return each.groupBy("__at").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(chosen)).select("__at")


def values_with(spark: SparkSession, index: TrigramIndex, needle: str) -> DataFrame:
    """low: every indexed value, lower-cased, that holds the text in any case. A text of under three characters is in no
    trigram: all values are read. Postings only propose, by hashes; each value is looked at."""
    needle = needle.lower()
    values = spark.read.schema(VALUES).parquet(index.values)
    grams = grams_of(needle)
    if grams:
        values = values.join(proposed(spark, index, grams), F.col("at") == F.col("__at"), "left_semi")
    return values.where(F.col("low").contains(needle)).select("low")


def rows_with(df: DataFrame, column: str, index: TrigramIndex, needle: str) -> DataFrame:
    """Rows of the indexed table whose value holds the text in any case. Rows meet the index by their value's hash, so no
    value is shuffled, and each proposed row is looked at."""
    needle, low = needle.lower(), F.lower(F.col(column).cast("string"))
    grams = grams_of(needle)
    if grams:
        df = df.join(proposed(df.sparkSession, index, grams), F.xxhash64(low) == F.col("__at"), "left_semi")
    return df.where(low.contains(needle))
