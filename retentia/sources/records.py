"""Sheets whose cells may hold line breaks, read in parts.

A file is read as lines, which Spark splits into blocks. Whether a block begins inside a quoted cell is the parity of the quotes
in the file's blocks before it: one grouped count and a running sum over one row a block. A second pass puts the lines of each
record together, a batch of lines at a time. What a block's border cuts, two pieces a block at most, is put together again by
file. No text but those pieces is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks whose parities are broadcast, some 100 bytes each; more are joined by a shuffle of the lines.
BROADCAST_BLOCKS = 200_000
#: One row a record or piece of one. head: a file's first record. continues, goes_on: cut by the block's begin or end.
PIECES = "file string, start long, text string, head boolean, continues boolean, goes_on boolean"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the line's block), place (rising within a block), value; a line's \\r belongs to its value."""
    found = spark.read.text(path, lineSep="\n")
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    return found.select(*where, "value").withColumn("place", F.monotonically_increasing_id())


def begins_quoted(lines: DataFrame) -> DataFrame:
    """file, start, quoted: whether a block begins inside a quoted cell."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("quoted"))


def pieces_of(batches):
    """Pieces of lines (file, start, value, quoted) that come in order, each block in one go. The last piece of a batch waits
    for the next one, as its record may go on there."""
    held, inside, first = None, False, True  # lines that wait; whether they begin in a quote; whether they begin their block
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held, inside, first, made = _pieces(t if held is None else pa.concat_tables([held, t]), inside, first, held is not None)
        if made.num_rows:
            yield made
    if held is not None:
        yield _pieces(held, inside, first, True, last=True)[3]


def _pieces(t: pa.Table, inside: bool, first: bool, held: bool, last: bool = False):
    t = t.combine_chunks()
    n = t.num_rows
    if n == 0:
        return None, False, True, _piece_batch(t, np.zeros(0, int), np.zeros(0, int), *[np.zeros(0, bool)] * 3)
    value, start = t.column("value").combine_chunks(), t.column("start").to_numpy()
    file = t.column("file").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new_block = np.append(True, (start[1:] != start[:-1]) | (file[1:] != file[:-1]))
    block = np.cumsum(new_block) - 1
    quoted = t.column("quoted").to_numpy(zero_copy_only=False)[new_block].astype(int)
    if held:
        quoted[0] = inside
    quotes = np.append(0, np.cumsum(pc.count_substring(value, '"').to_numpy(zero_copy_only=False)))
    at_block = quotes[:-1][new_block]
    before = (quotes[:-1] - at_block[block] + quoted[block]) % 2 == 1
    after = (quotes[1:] - at_block[block] + quoted[block]) % 2 == 1
    opens = np.flatnonzero(new_block | ~before)
    ends = np.append(opens[1:], n)
    begins = new_block[opens]
    if held:
        begins[0] = first
    continues, head = before[opens] & begins, begins & (start[opens] == 0)
    goes_on = after[ends - 1]
    k = len(opens) if last else len(opens) - 1
    made = _piece_batch(t, opens[:k], ends[:k], head[:k], continues[:k], goes_on[:k])
    return (None if last else t.slice(opens[-1])), bool(before[opens[-1]]), bool(begins[-1]), made


def _piece_batch(t: pa.Table, opens, ends, head, continues, goes_on) -> pa.RecordBatch:
    value = t.column("value").combine_chunks()
    bounds = pa.array(np.append(opens, ends[-1:]), pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(bounds, value), "\n") if len(opens) else pa.array([], pa.string())
    at = pa.array(opens, pa.int64())
    file, start = (t.column(c).combine_chunks().take(at) for c in ("file", "start"))
    return pa.RecordBatch.from_arrays([file, start, text, *(pa.array(x, pa.bool_()) for x in (head, continues, goes_on))], ["file", "start", "text", "head", "continues", "goes_on"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """text, head: every record of the files, line breaks in quotes included, and whether it is its file's first. Records that
    are blank are left out. A quote that is never closed makes the rest of its file one record."""
    found = lines(spark, path)
    blocks = begins_quoted(found)
    if blocks.count() <= BROADCAST_BLOCKS:
        marked = found.join(F.broadcast(blocks), ["file", "start"])  # keeps the order of the lines
    else:
        marked = found.join(blocks.hint("merge"), ["file", "start"]).sortWithinPartitions("file", "start", "place")
    pieces = marked.select("file", "start", "value", "quoted").mapInArrow(pieces_of, PIECES)
    cut = F.col("continues") | F.col("goes_on")
    whole = pieces.where(~cut).select("text", "head")
    number = F.count_if(~F.col("continues")).over(W.partitionBy("file").orderBy("start", F.desc("continues")))
    parts = pieces.where(cut).withColumn("number", number).groupBy("file", "number")
    in_order = F.array_sort(F.collect_list(F.struct("start", "text")))  # one piece a block
    glued = parts.agg(F.array_join(F.transform(in_order, lambda p: p.text), "\n").alias("text"), F.max("head").alias("head"))
    every = whole.union(glued.select("text", "head"))
    return every.select(F.regexp_replace("text", r"\r\z", "").alias("text"), "head").where(F.trim("text") != "")


def read_records(spark: SparkSession, path: str, columns: list[str], options: dict) -> DataFrame:
    """The records of a sheet's files but their headers, every column as text."""
    row = F.from_csv("text", ", ".join(f"`{c.replace('`', '``')}` string" for c in columns), options)
    return records(spark, path).where(~F.col("head")).select(row.alias("row")).select("row.*")
