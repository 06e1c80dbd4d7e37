"""Benchmark decontamination by greedy string tiling.

Words shared in runs of five (seeds) join documents with benchmark items; for each pair that could reach the threshold,
the longest common stretches are marked again and again, without overlap, found by running Karp-Rabin hashes. An item is
leaked by a document whose tiles cover enough of it, in whatever order its passages stand there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
#: Words of the shortest tile, and of a seed.
LEAST_TILE = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.8
#: Bytes of benchmark text that are broadcast at once; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20
LEAKS = "k long, tag long, item_id long, item_words long, covered_words long, n_tiles long, longest_tile long, coverage double"


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length): longest first, none overlapping, none shorter than `least` words."""
    p_item, p_doc = C.Prefix(item), C.Prefix(doc)
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles, size = [], len(item)

    def windows(prefix, free):
        used = np.append(0, np.cumsum(~free))
        at = np.flatnonzero(used[size:] == used[:-size]) if len(free) >= size else np.zeros(0, np.int64)
        return at, prefix.of(at, at + size)

    while size >= least:
        (a, ha), (b, hb) = windows(p_item, free_item), windows(p_doc, free_doc)
        order = np.argsort(hb, kind="stable")
        left = np.searchsorted(hb[order], ha, "left")
        right = np.searchsorted(hb[order], ha, "right")
        hits = np.flatnonzero(right > left)
        marked = False
        places = {}  # places of one hash, each looked at once: what is taken stays taken
        for h in hits.tolist():
            i = int(a[h])
            if not free_item[i : i + size].all():
                continue
            if left[h] not in places:
                places[left[h]] = iter(order[left[h] : right[h]].tolist())
            for x in places[left[h]]:
                j = int(b[x])
                if free_doc[j : j + size].all() and (item[i : i + size] == doc[j : j + size]).all():
                    free_item[i : i + size] = free_doc[j : j + size] = False
                    tiles.append((i, j, size))
                    marked = True
                    break
        if marked or size == least:
            size = size - 1
            continue
        # nothing of this length: halve it, and come back up to the longest match that the shorter windows show
        low, high = least, size - 1
        while low < high:
            middle = (low + high + 1) // 2
            size = middle
            if np.isin(windows(p_item, free_item)[1], windows(p_doc, free_doc)[1]).any():
                low = middle
            else:
                high = middle - 1
        size = low
    return tiles


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of letters and digits, lower case, and offsets of texts."""
    data, off = C.text_buffer(pc.utf8_lower(column))
    h, _, _, woff = C.word_hashes(data, off, C.MARKS)
    return h, woff


def scan(block, least: int, coverage: float):
    def run(batches):
        item_ids, item_words, item_off, seed, seed_item, seed_place = block.value
        for batch in batches:
            text, ids, tags = batch.column("text"), batch.column("k").to_pylist(), batch.column("tag").to_pylist()
            _, bytes_off = C.text_buffer(text)
            for i, j in C.chunks(bytes_off):
                words, off = words_of(text.slice(i, j - i))
                if not len(words):
                    continue
                rows = []
                prefix = C.Prefix(words)
                found_doc, found_seed = [], []
                for width in np.unique(np.minimum(np.diff(item_off), least)):
                    if width == 0 or len(words) < width:
                        continue
                    at = np.arange(len(words) - width + 1)
                    h = prefix.of(at, at + width)
                    lo = np.searchsorted(seed, h, "left")
                    hit = np.flatnonzero(seed[np.minimum(lo, len(seed) - 1)] == h)
                    doc = np.searchsorted(off, hit, "right") - 1
                    inside = hit + width <= off[doc + 1]
                    hit, doc = hit[inside], doc[inside]
                    first = lo[hit]
                    count = np.searchsorted(seed, h[hit], "right") - first
                    rep = np.repeat(np.arange(len(hit)), count)
                    found_doc.append(doc[rep])
                    found_seed.append(first[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count))
                if not found_doc:
                    continue
                doc, s = np.concatenate(found_doc), np.concatenate(found_seed)
                pair = np.unique(np.stack([doc, seed_item[s], seed_place[s]], 1), axis=0)
                edges = np.flatnonzero(np.append(C.changes(pair[:, 0], pair[:, 1]), True)) if len(pair) else []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    d, item = int(pair[a, 0]), int(pair[a, 1])
                    own = item_words[item_off[item] : item_off[item + 1]]
                    width = min(least, len(own))
                    cover = np.zeros(len(own) + 1, int)
                    np.add.at(cover, pair[a:b, 2], 1)
                    np.add.at(cover, pair[a:b, 2] + width, -1)
                    if (np.cumsum(cover) > 0).sum() < coverage * len(own):  # tiles are made of seeds
                        continue
                    tiles = greedy_tiles(own, words[off[d] : off[d + 1]], width)
                    covered = sum(t[2] for t in tiles)
                    if covered >= coverage * len(own):
                        rows.append((ids[i + d], tags[i + d], item_ids[item], len(own), covered, len(tiles), max(t[2] for t in tiles), covered / len(own)))
                if rows:
                    kinds = [*[pa.int64()] * 7, pa.float64()]
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in LEAKS.split(", ")])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, least_tile: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item of whose words the document's tiles cover `coverage` or more.

    docs: doc_id, text; benchmark: item_id, text; others ignored. Words are runs of letters and digits, in lower case. An
    item with fewer words than `least_tile` is sought whole. Returns doc_id, item_id, item_words, covered_words, n_tiles,
    longest_tile, coverage. Null or wordless texts and items: in no pair. Null ids: kept as they are. Repeated rows: a row
    each. Texts of any length are read whole. No documents or no items: no rows.
    """
    found = row_leaks(docs, benchmark, least_tile, coverage)
    return found.select(F.nullif("k", F.lit(C.NULL_ID)).alias("doc_id"), *found.columns[2:])


def row_leaks(docs: DataFrame, benchmark: DataFrame, least_tile: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """As leaks, with k and tag, which tell rows apart, in place of doc_id."""
    spark = docs.sparkSession
    C.small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / BLOCK_BYTES))
    texts = C.row_keyed(docs)
    out = []
    for n in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n).orderBy("item_id", "text").collect()  # BLOCK_BYTES of them
        words, off = words_of(pa.array([r.text for r in rows], pa.string()))
        size = np.diff(off)
        width = np.minimum(size, least_tile)
        count = np.where(size > 0, size - width + 1, 0)
        item = np.repeat(np.arange(len(rows)), count)
        place = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        start = off[:-1][item] + place
        seed = C.Prefix(words).of(start, start + width[item])
        order = np.argsort(seed, kind="stable")
        if len(order):
            block = spark.sparkContext.broadcast(([r.item_id for r in rows], words, off, seed[order], item[order], place[order]))
            out.append(texts.mapInArrow(scan(block, least_tile, coverage), LEAKS))
    if not out:
        return spark.createDataFrame([], LEAKS)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A table like documents without the rows whose text leaks an item. Other rows of the same id stay; null text stays;
    rows that repeat id and text go together. No items: all rows. No documents: no rows."""
    return C.picked_rows(docs, row_leaks(docs, benchmark).select("k", "tag").distinct(), "left_anti")
