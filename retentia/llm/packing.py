"""Order-preserving packing of token streams into windows of bounded length.

Each partition's documents form a stream. Windows may be cut at document ends (free), at sentence ends (a penalty) or,
within a sentence longer than a window, anywhere (a larger one); dynamic programming chooses the cuts that minimise
padding plus penalties. The best predecessor of a cut is a sliding minimum, kept in a monotone queue, so the work is
linear in the number of possible cuts. The last, short windows of the partitions are put together in order.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 4096
END_ID = 2
#: Penalties of a cut, in tokens of padding: at a document's end, at a sentence's end, elsewhere.
AT_DOCUMENT, AT_SENTENCE, ANYWHERE = 0, 16, 512
#: Tokens of a stream that are planned at once; bounds a worker's memory.
PLANNED = 1_000_000
#: Words whose ids a task remembers.
REMEMBERED = 400_000
#: Words that the tokenizer gets at once; its results take much memory.
ENCODED = 4000
TRAIL = np.zeros(256, bool)
TRAIL[[ord(c) for c in ".,!?;:"]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
PIECES = "pid int, seq long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, seq_length long, tail boolean"


def plan_cuts(total: int, at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows for a stream of `total` tokens with possible cuts `at` (ascending, the last is total)."""
    gaps = np.diff(np.append(0, at))
    if (gaps > window).any():  # cuts inside what no window holds
        extra = np.concatenate([np.arange(e - g + window, e, window) for e, g in zip(at[gaps > window], gaps[gaps > window], strict=True)])
        at, penalty = np.append(at, extra), np.append(penalty, np.full(len(extra), ANYWHERE))
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    ends, costs = at.tolist(), penalty.tolist()
    back = [0] * len(ends)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (cost of the best plan up to a cut plus its place, place, index)
    for j, end in enumerate(ends):
        while queue[0][1] < end - window:
            queue.popleft()
        best = queue[0]
        back[j] = best[2]
        value = best[0] + costs[j] + window  # = plan + padding (window - (end - place)) + penalty, and plus end for the queue
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, end, j))
    out, j = [], len(ends) - 1
    while j >= 0:
        out.append(ends[j])
        j = back[j]
    return out[::-1]


#: Words of these letters alone are one piece to the tokenizer's splitter, so its model takes them as they are.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
_tokenizers: dict = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it shows, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()


def loaded(path: str):
    """(the tokenizer, its model without normaliser and splitter), once in a worker's life."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        _tokenizers[path] = whole, Tokenizer(whole.model)
    return _tokenizers[path]


def encoded(words: list[str], whole, model) -> list[list[int]]:
    lower = [w.lower() for w in words]
    plain = [i for i, w in enumerate(lower) if PLAIN(w)]
    out: list[list[int]] = [[]] * len(words)
    for i, e in zip(plain, model.encode_batch_fast([lower[i].encode().decode("latin-1").translate(BYTE_LETTERS) for i in plain], add_special_tokens=False), strict=True):
        out[i] = e.ids
    rest = sorted(set(range(len(words))) - set(plain))
    for i, e in zip(rest, whole.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = e.ids
    return out


class WordIds:
    """Token ids of words, remembered by the words' hashes."""

    def __init__(self, tokenizer_path: str):
        self.whole, self.model = loaded(tokenizer_path)
        self.clear()

    def clear(self):
        self.hashes = np.zeros(0, np.uint64)
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def of(self, raw: bytes, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, distinct)
        where[where == len(self.hashes)] = 0
        new = self.hashes[where] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.hashes) + new.sum() > REMEMBERED:
                self.clear()
                new[:] = True
            words = [raw[a:b].decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            sizes, parts = [], []
            for a in range(0, len(words), ENCODED):
                got = encoded(words[a : a + ENCODED], self.whole, self.model)
                sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
                parts.append(np.fromiter((i for x in got for i in x), np.uint32, sizes[-1].sum()))
            size, ids = np.concatenate(sizes), np.concatenate(parts)
            hashes = np.append(self.hashes, distinct[new])
            first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
            self.ids = np.append(self.ids, ids)
            order = np.argsort(hashes)
            self.hashes, self.first, self.size = hashes[order], first[order], np.append(self.size, size)[order]
            where = np.searchsorted(self.hashes, distinct)
        row = where[back]
        size = self.size[row]
        place = np.repeat(self.first[row] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.ids[place], size


def tokens(data: np.ndarray, off: np.ndarray, words: WordIds):
    """(ids with END_ID after each document, offsets of documents, places of sentence ends) of a chunk of documents.

    A word's trailing punctuation after a letter is looked up on its own, for it never joins the letters; upper case
    ASCII letters are lower-cased as the tokenizer does."""
    raw = data.tobytes()
    start, end, woff = C.word_bounds(data, off)
    stem = end.copy()
    live = np.ones(len(end), bool)
    while True:
        live &= (stem > start) & TRAIL[data[np.maximum(stem - 1, 0)]]
        if not live.any():
            break
        stem[live] -= 1
    cut = (stem < end) & (stem > start)
    cut &= LETTER[data[np.maximum(stem - 1, 0)]]
    stem = np.where(cut, stem, end)
    # every word, and after it its cut-off trail
    at = np.repeat(np.arange(len(start)), 1 + cut)
    second = np.zeros(len(at), bool)
    second[1:] = at[1:] == at[:-1]
    a, b = np.where(second, stem[at], start[at]), np.where(second, end[at], stem[at])
    ids, size = words.of(raw, C.Prefix(C.BYTE_VALUES[C.LOWER[data]]).of(a, b) if b"<|" not in raw else C.Prefix(C.BYTE_VALUES[data]).of(a, b), a, b)
    reach = np.append(0, np.cumsum(size))
    first_part = np.searchsorted(at, np.append(woff, len(start))[: len(woff)])
    doc_at = reach[first_part]  # offsets of documents without end ids
    n = len(off) - 1
    toff = doc_at + np.arange(n + 1)
    out = np.full(len(ids) + n, END_ID, np.uint32)
    doc = np.searchsorted(first_part, np.arange(len(at)), "right") - 1
    out[np.arange(len(ids)) + np.repeat(doc, size)] = ids
    nl = np.append(data, np.uint8(10))[end] == 10
    full = nl | np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)) if len(end) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(~second)[1:] - 1, len(at) - 1) if len(at) else np.zeros(0, np.int64)
    stops = reach[last[full] + 1] + doc[last[full]]
    return out, toff, stops


class Stream:
    """The documents of a partition that aren't packed yet."""

    def __init__(self, pid: int, window: int):
        self.pid, self.window, self.seq = pid, window, 0
        self.ids, self.docs, self.ends, self.stops, self.size = [], [], [], [], 0  # docs: (id, tokens of it packed before, tokens)

    def add(self, doc_ids, ids, toff, stops):
        self.ids.append(ids)
        self.stops.append(stops + self.size)
        n = np.diff(toff)
        self.docs += zip(doc_ids, [0] * len(n), n.tolist(), strict=True)
        self.ends.append(toff[1:] + self.size)
        self.size += len(ids)

    def packed(self, last: bool):
        """Pieces of all windows that are settled: all but the last one, and that too if `last`."""
        if not self.size:
            return
        ids, ends, stops = np.concatenate(self.ids), np.concatenate(self.ends), np.concatenate(self.stops)
        at = np.unique(np.concatenate([ends, stops]))
        at = at[at > 0]
        penalty = np.where(np.isin(at, ends), AT_DOCUMENT, AT_SENTENCE)
        cuts = plan_cuts(self.size, at, penalty, self.window)
        go = len(cuts) if last else len(cuts) - 1
        rows, begin, d = [], 0, 0
        for q, cut in enumerate(cuts[:go]):
            place = begin
            tail = last and q + 1 == go
            while place < cut:
                doc_id, before, total = self.docs[d]
                head = int(ends[d]) - (total - before)  # where the rest of the document begins
                stop = min(cut, int(ends[d]))
                start = before + place - head
                rows.append((self.pid, self.seq, doc_id, start, stop - place, zlib.crc32(ids[place:stop].tobytes()), total, place - begin, cut - begin, tail))
                place = stop
                if stop == ends[d]:
                    d += 1
            begin = cut
            self.seq += 1
        if go:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), *[pa.int64()] * 8, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
        rest = self.docs[d:]
        if rest and begin > int(ends[d]) - (rest[0][2] - rest[0][1]):
            doc_id, before, total = rest[0]
            rest[0] = (doc_id, total - (int(ends[d]) - begin), total)
        self.docs, self.ids, self.ends = rest, [ids[begin:]], [ends[d:] - begin]
        self.stops, self.size = [stops[stops > begin] - begin], self.size - begin


def pack_partition(tokenizer_path: str, window: int):
    def run(batches):
        words = WordIds(tokenizer_path)
        stream = Stream(TaskContext.get().partitionId(), window)
        for batch in batches:
            data, off = C.text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in C.chunks(off):
                stream.add(ids[i:j], *tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], words))
                if stream.size >= PLANNED:
                    yield from stream.packed(False)
        yield from stream.packed(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Packs documents, in the order of their partition, into windows. docs: doc_id, text, others ignored; tokenizer_path:
    a file of the tokenizers library that is there on every machine.

    A document's ids are the tokenizer's, without special ones, and then END_ID. Returns a row per piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset. Each id is in one piece; pieces of a sequence are gapless from
    offset 0. Null text: the end id alone. Null doc_id and repeated rows: documents like others. A document longer than a
    window is cut, at sentence ends where it has them. No documents: no rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    pieces = C.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack_partition(tokenizer_path, window), PIECES))
    # a row for each partition: how many windows it filled, and the length of its last, short one
    parts = pieces.where("offset = 0").groupBy("pid").agg(F.count_if(~F.col("tail")).alias("full"), F.max(F.when(F.col("tail"), F.col("seq_length"))).alias("tail_length"))
    rows, base, places = sorted(parts.collect()), 0, []
    shared = sum(r.full for r in rows)
    room, tail_id = 0, shared - 1
    for r in rows:
        if r.tail_length > room:
            room, tail_id = window, tail_id + 1
        places.append((r.pid, base, tail_id, window - room))
        room -= r.tail_length
        base += r.full
    where = spark.createDataFrame(places, "pid int, base long, tail_id long, tail_offset long")
    tail = F.col("tail")
    return pieces.join(F.broadcast(where), "pid").select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.when(tail, F.col("tail_id")).otherwise(F.col("base") + F.col("seq")).alias("sequence_id"),
        F.when(tail, F.col("tail_offset") + F.col("offset")).otherwise(F.col("offset")).alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
