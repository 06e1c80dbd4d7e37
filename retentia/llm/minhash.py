"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification.

Two permutations make all signature coordinates: the first spreads shingles over a universe of slots, the second gives
each slot a rank, and coordinate i is the least rank of the document's slots shifted circularly by i.

Documents with one shingle set are one class. Class representatives that share a band are candidates. A bucket is first
verified as stars: its members are dealt into cells of bounded size by bits of a hash, each cell is a star around its
least member, and the cells' centres are one around the bucket's least. Where that leaves several components in a bucket
of three or more, what lies outside its largest component is compared with the rest, in blocks. So no pairs are made
within a group of copies, no member is a centre to more than a cell, and every candidate pair is verified or already
connected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components

U64 = np.uint64
#: 5 rows in each of 30 bands: a pair at similarity 0.8 is missed with probability (1 - 0.8**5)**30 < 7e-6.
ROWS, BANDS = 5, 30
#: Slots of the universe (a power of two); more than the shingles of any but giant documents.
SLOTS = 1 << 20
#: Words in a shingle of the pipeline's stage; op7's contract has two.
STAGE_WORDS = 5
#: Members of a cell about, and documents on each side of a block when a bucket is compared across its components.
CELL, BLOCK = 200, 500
SIGNED = "k long, tag long, f1 long, f2 long, n_shingles long, bands array<long>"


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each document, sorted within it, and their offsets. Fewer words than `size`: the
    whole sequence is the one shingle."""
    h, _, _, woff = C.word_hashes(C.LOWER[data], off)
    prefix, words = C.Prefix(h), np.diff(woff)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), count)
    start = woff[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    sh = prefix.of(start, start + np.minimum(words[doc], size))
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    keep = C.changes(doc, sh)
    sh, doc = sh[keep], doc[keep]
    return sh, np.searchsorted(doc, np.arange(len(words) + 1))


_ranks: dict[int, np.ndarray] = {}


def signatures(sh: np.ndarray, off: np.ndarray, rows: int, bands: int, slots: int = SLOTS) -> np.ndarray:
    """Band hashes (documents x bands); documents without shingles get zeros."""
    full = np.flatnonzero(np.diff(off) > 0)
    out = np.zeros((len(off) - 1, bands), U64)
    if not len(full):
        return out
    if slots not in _ranks:
        _ranks[slots] = np.random.default_rng(20).permutation(slots).astype(np.uint32)
    ranks = _ranks[slots]
    slot = (C.splitmix(sh ^ U64(0x5851F42D4C957F2D)) >> U64(40)).astype(np.int32) & np.int32(slots - 1)
    at = off[full]
    for band in range(bands):
        mixed = np.full(len(full), band + 1, U64)
        for i in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat(ranks[(slot - np.int32(i)) & np.int32(slots - 1)], at)
            mixed = C.splitmix(mixed * C.MULT + least)
        out[full, band] = mixed
    return out


def sign(size: int, rows: int, bands: int):
    def run(batches):
        for batch in batches:
            data, off = C.text_buffer(batch.column("text"))
            k, tag = batch.column("k"), batch.column("tag")
            for i, j in C.chunks(off):
                sh, soff = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                sums = [np.append(U64(0), np.cumsum(x)) for x in (C.splitmix(sh), C.splitmix(sh ^ U64(0x2545F4914F6CDD1D)))]
                f1, f2 = ((s[soff[1:]] - s[soff[:-1]]).view(np.int64) for s in sums)
                out = signatures(sh, soff, rows, bands).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bands, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([k.slice(i, j - i), tag.slice(i, j - i), pa.array(f1), pa.array(f2), pa.array(np.diff(soff)), lists], ["k", "tag", "f1", "f2", "n_shingles", "bands"])

    return run


def verify(size: int, least_percent: int):
    def run(batches):
        for batch in batches:
            sides = [C.text_buffer(batch.column(c)) for c in ("text_a", "text_b")]
            weight = sides[0][1] + sides[1][1]
            a, b = batch.column("a"), batch.column("b")
            for i, j in C.chunks(weight):
                sets = [shingle_sets(d[o[i] : o[j]], o[i : j + 1] - o[i], size) for d, o in sides]
                sh = np.concatenate([s for s, _ in sets])
                pair = np.concatenate([np.repeat(np.arange(j - i), np.diff(o)) for _, o in sets])
                order = np.lexsort((sh, pair))
                sh, pair = sh[order], pair[order]
                both = np.bincount(pair[1:][(sh[1:] == sh[:-1]) & (pair[1:] == pair[:-1])], minlength=j - i)
                union = np.bincount(pair, minlength=j - i) - both
                hit = pa.array((100 * both >= least_percent * union) & (both > 0))
                yield pa.RecordBatch.from_arrays([a.slice(i, j - i).filter(hit), b.slice(i, j - i).filter(hit)], ["a", "b"])

    return run


def compare_block(size: int, least_percent: int):
    """Links between some documents (`sought`) and others of the block that lie in other components, as few as connect what
    is similar."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sought", "k"])
        texts = [t.encode() for t in rows["text"]]
        off = np.append(0, np.cumsum([len(t) for t in texts]))
        sh, soff = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), off, size)
        comp, k, sought = rows["comp"].to_numpy().copy(), rows["k"].to_numpy(), rows["sought"].to_numpy(bool)
        others = int((~sought).sum())  # these come first
        vocabulary, term = np.unique(sh, return_inverse=True)
        sizes = np.diff(soff)
        doc = np.repeat(np.arange(others), sizes[:others])
        order = np.argsort(term[: soff[others]], kind="stable")
        posting = doc[order]
        poff = np.searchsorted(term[: soff[others]][order], np.arange(len(vocabulary) + 1))
        found = []
        for x in range(others, len(texts)):
            rest = comp[:others] != comp[x]
            if not rest.any():
                continue
            own = term[soff[x] : soff[x + 1]]
            length = poff[own + 1] - poff[own]
            where = np.repeat(poff[own] - np.cumsum(length) + length, length) + np.arange(length.sum())
            both = np.bincount(posting[where], minlength=others)
            near = rest & (100 * both >= least_percent * (sizes[:others] + sizes[x] - both)) & (both > 0)
            for y in np.flatnonzero(near):
                if comp[y] != comp[x]:
                    found.append((k[x], k[y]))
                    comp[comp == comp[y]] = comp[x]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def stars(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From members (bucket, k, n) of buckets: pairs a < b of members with their cell's least one, and these (bucket, k).

    A bucket of n has as many cells as the power of two that makes them CELL or smaller, by the first bits of a hash of k:
    a document has the same neighbours in every bucket of a size."""
    cells = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("n") / CELL)))).cast("long")
    dealt = shared.select("bucket", "k", F.pmod(F.xxhash64("k", F.lit(9)), cells).alias("cell"))
    least = dealt.groupBy("bucket", "cell").agg(F.min("k").alias("a"))
    inner = dealt.join(least, ["bucket", "cell"]).select("a", F.col("k").alias("b"))
    return inner.where("a <> b"), least.select("bucket", F.col("a").alias("k"))


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """k, text of the documents whose ids are in `ids` (k, distinct); few ids are broadcast, after a count of them."""
    few = ids.count() <= C.BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "k", "left_semi")


def near_duplicates(docs: DataFrame, shingle_words: int = 2, least_percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Components of documents whose sets of word shingles have 100 * intersection >= least_percent * union.

    docs: doc_id, text, others ignored; words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Returns a row per document:
    doc_id, n_shingles, component_id (the smallest doc_id reachable, its own included), kept (doc_id = component_id).

    Null text, or one without words: empty set, linked with nothing. Null doc_id: smaller than any other. Sets that share
    their smallest doc_id (repeats of a row) are one node, so rows that repeat are kept or dropped together. Texts of more
    distinct shingles than SLOTS: nearly all slots are taken, so their signatures agree and more of them are compared; no
    link is lost. No documents: no rows.
    """
    found = row_components(docs, shingle_words, least_percent, rows, bands)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def row_components(docs: DataFrame, shingle_words: int, least_percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """As near_duplicates, with k and tag that tell rows apart."""
    spark = docs.sparkSession
    C.small_batches(spark)
    keyed = C.row_keyed(docs)
    signed = C.written(keyed.mapInArrow(sign(shingle_words, rows, bands), SIGNED))
    classes = C.written(signed.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("k").alias("rep"), F.first("bands").alias("bands")))
    comp = linked(classes, lambda nodes: with_texts(keyed.select("k", "text"), nodes), shingle_words, least_percent)
    by_rep = classes.select("f1", "f2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_rep.select("f1", "f2", F.coalesce("comp", "rep").alias("comp"))
    out = signed.select("k", "tag", "f1", "f2", "n_shingles").join(by_class, ["f1", "f2"], "left")
    least = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("k"))
    as_id = lambda c: F.nullif(c, F.lit(C.NULL_ID))
    return out.select("k", "tag", as_id(F.col("k")).alias("doc_id"), "n_shingles", as_id(least).alias("component_id"), (F.col("k") == least).alias("kept"))


def row_groups(docs: DataFrame, shingle_words: int, least_percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """k, tag and stays of every row: of each component of sets the row of least k, then tag, and its exact repeats; and rows
    without words. Ids link nothing here: each set is a node of its own, whatever ids its rows have."""
    spark = docs.sparkSession
    C.small_batches(spark)
    keyed = C.row_keyed(docs)
    signed = C.written(keyed.mapInArrow(sign(shingle_words, rows, bands), SIGNED))
    row = F.struct("k", "tag")
    classes = signed.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min(row).alias("row"), F.first("bands").alias("bands"))
    classes = C.written(classes.withColumn("rep", F.monotonically_increasing_id()))  # fixed by being written
    repeats = not signed.groupBy("k", "tag").count().where("count > 1").isEmpty()

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = C.written(classes.select("rep", F.col("row.k").alias("k"), F.col("row.tag").alias("tag")).join(nodes.toDF("rep"), "rep"))
        few = wanted.count() <= C.BROADCAST_IDS
        found = keyed.join(F.broadcast(wanted) if few else wanted, ["k", "tag"]).select(F.col("rep").alias("k"), "text")
        return found.groupBy("k").agg(F.first("text").alias("text")) if repeats else found

    comp = linked(classes, texts_of, shingle_words, least_percent)
    placed = classes.select("f1", "f2", "rep", "row").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    first = placed.where("comp is not null").groupBy("comp").agg(F.min("row").alias("first"))
    by_class = placed.join(first, "comp", "left").select("f1", "f2", F.coalesce("first", "row").alias("first"))
    out = signed.select("k", "tag", "f1", "f2").join(by_class, ["f1", "f2"], "left")
    return out.select("k", "tag", (F.col("first").isNull() | (row == F.col("first"))).alias("stays"))


def linked(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle_words: int, least_percent: int) -> DataFrame:
    """node, comp of the classes (rep: a node, bands) that are linked. texts_of: k, text of the nodes of a table (k)."""
    member = C.written(classes.select(F.col("rep").alias("k"), F.explode("bands").alias("bucket")))
    buckets = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = C.written(member.join(buckets, "bucket"))
    largest = shared.agg(F.max("n")).first()[0] or 0
    pairs, centres = stars(shared)
    while largest > CELL:  # centres of large buckets, once for each time CELL goes into their size
        sizes = centres.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        centres = C.written(centres.join(sizes, "bucket"))
        largest = centres.agg(F.max("n")).first()[0] or 0
        more, centres = stars(centres)
        pairs = pairs.union(more)
    pairs = C.written(pairs.distinct())
    texts = texts_of(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()).repartition("k")
    sides = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    links = C.written(sides.select("a", "b", "text_a", "text_b").mapInArrow(verify(shingle_words, least_percent), "a long, b long"))
    comp = components(links)

    placed = shared.where("n > 2").join(comp.withColumnRenamed("node", "k"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    placed = C.written(placed.select("bucket", "k", "comp"))
    mark = F.xxhash64("k").cast("decimal(38,0)")
    by_comp = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum(mark).alias("mark"))
    mixed = by_comp.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("mark").alias("mark"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("major"))
    once = mixed.where("parts > 1").groupBy("n", "mark").agg(F.min(F.struct("bucket", "most", "major")).alias("b"))  # one of the buckets with equal members
    open_ = C.written(placed.join(once.select("b.*", "n"), "bucket"))
    if open_.isEmpty():
        return comp
    split = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK).cast("int"))
    down, across = split(F.col("n") - F.col("most")), split(F.col("n"))
    part = lambda of: F.pmod(F.xxhash64("k", F.lit(3)), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    sought = open_.where("comp <> major").select("bucket", "k", "comp", F.lit(1).alias("sought"), part(down).alias("i"), every(across).alias("j"))
    others = open_.select("bucket", "k", "comp", F.lit(0).alias("sought"), every(down).alias("i"), part(across).alias("j"))
    here = texts_of(open_.select("k").distinct())
    groups = sought.union(others).join(here, "k").groupBy("bucket", "i", "j")
    return components(links.union(groups.applyInPandas(compare_block(shingle_words, least_percent), "a long, b long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """A table like documents with one row of each component of near-duplicate texts, that of the smallest doc_id (of several
    texts of that id one), and its exact repeats; documents without words stay. Rows are told apart by id and text, so a row
    that goes takes no other text of its id with it.

    Shingles have five words, not op7's two: a few scattered changes keep most word pairs of a document as they are, so
    two words link, and drop, documents that differ. Documents of fewer words are compared as a whole."""
    others = row_groups(docs, STAGE_WORDS).where("not stays").select("k", "tag").distinct()
    return C.picked_rows(docs, others, "left_anti")
