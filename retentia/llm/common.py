"""What the corpus operators share: the shared folder, Arrow text buffers, vectorised words and hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass holds at once; bounds a worker's memory.
CHUNK_BYTES = 1 << 20
#: Rows of one Arrow batch between Spark and a worker.
BATCH_ROWS = 1000
NULL_ID = -(2**63)

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)
MULT_INV = U64(pow(int(MULT), -1, 2**64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master, whose executors are the driver's own, may do without
    one: it gets a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Whole documents travel in Arrow batches, so these are kept short."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed_documents(docs: DataFrame, carry: list[str] | tuple = ()) -> DataFrame:
    """doc_id, k (null id: the smallest), tag (tells rows with one id apart) and text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"),
        F.crc32(text.cast("binary")).alias("tag"),
        text.alias("text"),
        *carry,
    )


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Ids that may be broadcast to pick documents.
BROADCAST_IDS = 200_000


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """k (null id: the smallest) and tag (a hash of the text) tell a table's rows apart, but for exact repeats."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def row_keyed(docs: DataFrame) -> DataFrame:
    """k, tag and text (null: empty)."""
    k, tag = row_key(docs)
    return docs.select(k.alias("k"), tag.alias("tag"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def picked_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with rows (k, tag; distinct). The keys are written and counted first; few are broadcast,
    and then documents needn't be shuffled."""
    rows = written(rows.select("k", "tag"))
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    k, tag = row_key(docs)
    return docs.join(rows, (k == rows["k"]) & (tag == rows["tag"]), how)


#: A 64-bit value for each byte.
BYTE_VALUES = splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: What parts words of letters and digits: all other ASCII.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for base in (MULT, MULT_INV):
            p = np.full(size, base, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Prefix:
    """Rolling hashes of any stretch of a sequence of 64-bit values, by prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return splitmix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def of_width(self, k: int) -> np.ndarray:
        """For each start, the unmixed hash of the k values from there."""
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets), without a copy where possible; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges (i, j) of documents of about `most` symbols in sum; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, [^\\x20\\x09-\\x0D]+ by default, and the offsets of each document's words."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(space[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    cut = edges[inside[edges] & inside[edges + 1]]  # a word before and one after the border of two documents
    first[cut] = True
    last[cut - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, starts, ends, offsets of each document's words)."""
    starts, ends, woff = word_bounds(data, off, space)
    return Prefix(BYTE_VALUES[data]).of(starts, ends), starts, ends, woff


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as a compressed blob."""
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = size // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def multikey_quicksort(keys: list) -> np.ndarray:
    """The order of rows by several key columns: sort by the first, then only the groups that tie by the next.

    Column by column this is multikey quicksort: a partition by the d-th symbol, and only its equal parts go on to symbol
    d + 1. A key is an array, or a function from row numbers to values, so that later symbols are only read for ties."""
    get = lambda key, rows: key(rows) if callable(key) else key[rows]
    first = keys[0](slice(None)) if callable(keys[0]) else keys[0]
    n = len(first)
    order = np.argsort(first)
    group = np.zeros(n, np.int64)
    tied = np.arange(n)
    for d, key in enumerate(keys):
        values = get(key, order[tied])
        if d:
            inner = np.lexsort((values, group[tied]))
            order[tied], values = order[tied][inner], values[inner]
        if d + 1 == len(keys):
            break
        ids = np.cumsum(changes(values, group[tied]))
        group[tied] = ids
        tied = tied[np.bincount(ids, minlength=1)[ids] > 1]
        if not len(tied):
            break
    return order


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open intervals."""
    if len(lo) == 0:
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]
