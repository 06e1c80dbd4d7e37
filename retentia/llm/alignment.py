"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both token sequences of a text are arrays of byte ends. Where A's and B's ends meet, a group ends. From a group's start at
(i, j) the ends are compared at the index shift j - i in blocks of 1, 2, 4, ... tokens: as long as they agree the groups are
one to one and are jumped together. At the first difference the group is irregular; the side that is behind advances until
the ends meet again, which gives the next shift. Many texts run side by side, each at its own place.

Documents are encoded once. Each task adds up in how many documents its id pairs are linked, so Spark shuffles counts of
pairs, not links; counts then go back to the documents by a broadcast of the commonest pairs and a join of the rest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .packing import BYTE_LETTERS

#: Bytes of a text that one lane covers; longer texts are cut where both tokenizers surely end.
LANE_BYTES = 512
#: Segments of text whose tokens a task remembers, the longest that it remembers, and bytes that are encoded at once.
REMEMBERED, LONGEST, ENCODED_BYTES = 800_000, 64, 200_000
#: Id pairs of a task before it passes their counts on.
COUNTED = 1_000_000
#: Pairs whose counts are broadcast (16 bytes each); beyond, counts are joined.
BROADCAST_PAIRS = 2_000_000
#: Ids of either tokenizer are below this.
IDS = 1 << 20
#: Tokens of a group whose pairs are made one by one; pairs of larger groups are made of distinct ids.
LARGE_GROUP = 256

#: First bytes of characters that are surely neither white space nor a mark that joins what is before it: printable ASCII,
#: and the Latin letters from U+00C0 to U+00FF.
SOLID = np.zeros(256, bool)
SOLID[33:127] = True
SOLID[0xC3] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in ".,!?;:"]] = True
#: A byte-level tokenizer's splitter leaves these texts whole, so its model takes them as they are.
PLAIN = re.compile("[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def safe_cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places of spaces and line breaks between two solid characters, and of marks between a letter and white space. No token
    of either tokenizer reaches over the border before one; a space is the first byte of the next token in both, as it is at
    the start of a text."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    inner = data[1:-1]
    at = np.flatnonzero((inner == 32) | (inner == 10) | MARK[inner]) + 1
    accented = (at > 1) & (data[np.maximum(at - 2, 0)] == 0xC3) & (data[at - 1] >= 0x80)
    before = np.where(MARK[data[at]], LETTER[data[at - 1]], SOLID[data[at - 1]] & (data[at - 1] < 127)) | accented
    after = np.where(MARK[data[at]], (data[at + 1] == 32) | (data[at + 1] == 10), SOLID[data[at + 1]])
    at = at[before & after]
    doc = np.searchsorted(off, at, "right") - 1  # neither the first nor the last byte of its text, nor beside it
    return at[(at > off[doc] + 1) & (at < off[doc + 1] - 1)]


class Ragged:
    """Lists of ids, one after another, that can be looked up by number."""

    def __init__(self, lists: list, kind):
        self.size = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids = np.fromiter((i for x in lists for i in x), kind, int(self.size.sum()))
        self.first = np.cumsum(self.size) - self.size

    def join(self, other: Ragged) -> None:
        self.first = np.append(self.first, len(self.ids) + other.first)
        self.size, self.ids = np.append(self.size, other.size), np.append(self.ids, other.ids)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[rows]
        place = np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.ids[place], size


class Pair:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in BYTE_LETTERS.items()}
        vocabulary = self.a.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            tokens[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(len(tokens), len(pieces)) >= IDS:
            raise ValueError("more ids than a pair's code has room for")
        self.bytes_a = Ragged(tokens, np.uint8)
        self.bytes_b = Ragged([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], np.uint8)
        if any("\n" in p or re.search(r"[A-Za-zÀ-ÿ][.,!?;:]", p) for p in pieces):
            raise ValueError("pieces that hold a line break, or a mark after a letter, would reach over cuts")
        self.model = Tokenizer(self.a.model)

    def encoded(self, texts: list[str], inside: np.ndarray) -> tuple[Ragged, Ragged, np.ndarray]:
        """(ids of A, ids of B, whether both join to the text) of each text: space + text, or, inside, the text alone. No
        piece of B holds a line break, so what it has for a text after a break begins with two pieces for space and break."""
        spaced = [t if i else " " + t for t, i in zip(texts, inside.tolist(), strict=True)]
        after = ["\n" + t if i else t for t, i in zip(texts, inside.tolist(), strict=True)]
        plain = [bool(PLAIN(t)) for t in spaced]
        a, b, size, at = [], [], 0, 0
        for i, t in enumerate(texts):  # a tokenizer's results take many times the texts' memory
            size += len(t)
            if size > ENCODED_BYTES or i + 1 == len(texts):
                part, simple = spaced[at : i + 1], plain[at : i + 1]
                found = iter(self.model.encode_batch_fast([t.encode().decode("latin-1").translate(BYTE_LETTERS) for t, p in zip(part, simple, strict=True) if p], add_special_tokens=False))
                others = iter(self.a.encode_batch_fast([t for t, p in zip(part, simple, strict=True) if not p], add_special_tokens=False))
                a += [next(found if p else others).ids for p in simple]
                b += self.b.encode(after[at : i + 1], num_threads=1)
                size, at = 0, i + 1
        for i in np.flatnonzero(inside).tolist():
            b[i] = b[i][2:]
        a, b = Ragged(a, np.int32), Ragged(b, np.int32)
        whole = [t.encode() for t in spaced]
        return a, b, joins_to(self.bytes_a, a, whole) & joins_to(self.bytes_b, b, whole)


def joins_to(token_bytes: Ragged, ids: Ragged, texts: list[bytes]) -> np.ndarray:
    """Whether each list's tokens are the bytes of its text."""
    reach = np.append(0, np.cumsum(token_bytes.size[ids.ids]))
    made = np.diff(reach[np.append(ids.first, len(ids.ids))])
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    same = made == size
    joined, theirs = token_bytes.take(ids.ids)[0], np.frombuffer(b"".join(texts), np.uint8)
    joined, theirs = joined[np.repeat(same, made)], theirs[np.repeat(same, size)]
    wrong = np.searchsorted(np.cumsum(size[same]), np.flatnonzero(joined != theirs), "right")
    same[np.flatnonzero(same)[wrong]] = False
    return same


_pairs: dict = {}


def loaded(path_a: str, path_b: str) -> Pair:
    """The tokenizers, once in a worker's life."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


class Segments:
    """Tokens of both tokenizers for segments of text, remembered by the segments' hashes."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self):
        self.hashes, self.row, self.same = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.a, self.b = Ragged([], np.int32), Ragged([], np.int32)

    def of(self, raw: bytes, h: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray):
        """(A's ids, their number in each segment, B's ids, their number, whether both join to the text) of all segments."""
        if len(self.hashes) > REMEMBERED:
            self.clear()
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, distinct)
        where[where == len(self.hashes)] = 0
        new = np.flatnonzero(self.hashes[where] != distinct) if len(self.hashes) else np.arange(len(distinct))
        row = self.row[where] if len(self.row) else np.zeros(len(distinct), np.int64)
        before = len(self.same)
        if len(new):
            new = new[np.argsort(end[at[new]] - start[at[new]] > LONGEST, kind="stable")]  # what is forgotten comes last
            a, b, same = self.pair.encoded([raw[i:j].decode() for i, j in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)], inside[at[new]])
            self.a.join(a)
            self.b.join(b)
            self.same = np.append(self.same, same)
            row[new] = before + np.arange(len(new))
        row = row[back]
        out = *self.a.take(row), *self.b.take(row), self.same[row]
        if len(new):
            short = new[end[at[new]] - start[at[new]] <= LONGEST]
            kept = before + len(short)
            for ids in (self.a, self.b):
                ids.size, ids.first = ids.size[:kept], ids.first[:kept]
                ids.ids = ids.ids[: int(ids.first[-1] + ids.size[-1]) if kept else 0]
            self.same = self.same[:kept]
            hashes = np.append(self.hashes, distinct[short])
            order = np.argsort(hashes)
            self.hashes, self.row = hashes[order], np.append(self.row, before + np.arange(len(short)))[order]
        return out


def run_groups(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens (in A, in B) of all groups, ascending. Lane l aligns the ends a[a_from[l]:a_to[l]] with
    b[b_from[l]:b_to[l]]; the last ends of a lane are equal, and its ends ascend strictly."""
    found = []  # (places in A, places in B, lengths of one-to-one runs)
    i, j, a_to, b_to = a_from.copy(), b_from.copy(), a_to.copy(), b_to.copy()
    while True:
        live = (i < a_to) & (j < b_to)
        if not live.all():
            i, j, a_to, b_to = i[live], j[live], a_to[live], b_to[live]
        if not len(i):
            break
        # exponential probing along the diagonal
        run = np.zeros(len(i), np.int64)
        probing, width = np.arange(len(i)), 1
        while len(probing):
            p, q = i[probing] + run[probing], j[probing] + run[probing]
            room = np.minimum(np.minimum(a_to[probing] - p, b_to[probing] - q), width)
            step = np.arange(width)
            differ = a[np.minimum(p[:, None] + step, len(a) - 1)] != b[np.minimum(q[:, None] + step, len(b) - 1)]
            differ |= step >= room[:, None]
            stop = differ.any(1)
            run[probing] += np.where(stop, differ.argmax(1), width)
            probing, width = probing[~stop], 2 * width
        some = run > 0
        found.append((i[some], j[some], run[some]))
        i, j = i + run, j + run
        # an irregular group begins where the ends differ; the side that is behind goes on until they meet
        open_ = np.flatnonzero((i < a_to) & (j < b_to))
        found.append((i[open_], j[open_], np.ones(len(open_), np.int64)))
        while len(open_):
            x, y = a[i[open_]], b[j[open_]]
            met = x == y
            done = open_[met]
            i[done] += 1
            j[done] += 1
            i[open_] += x < y
            j[open_] += x > y
            open_ = open_[~met]
    size = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    first_a = np.repeat(np.concatenate([f[0] for f in found]) if found else size, size) + within
    first_b = np.repeat(np.concatenate([f[1] for f in found]) if found else size, size) + within
    return np.sort(first_a), np.sort(first_b)


class Aligned:
    """Tokens and groups of a chunk of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, segments: Segments):
        n = len(off) - 1
        raw, pair = data.tobytes(), segments.pair
        cuts = safe_cuts(data, off)
        start = np.sort(np.concatenate([off[np.flatnonzero(np.diff(off))], cuts]))
        cut = np.isin(start, cuts)
        inside = cut & (data[start] != 32)
        begin, end = start + (cut & ~inside), np.append(start, len(data))[1:]  # both tokenizers put the space before a text
        h = C.Prefix(C.BYTE_VALUES[data]).of(begin, end) ^ inside.astype(np.uint64)
        self.a, size_a, self.b, size_b, same = segments.of(raw, h, begin, end, inside)
        doc = np.searchsorted(off, start, "right") - 1
        sound = np.ones(n, bool)
        sound[doc[~same]] = False
        if not sound.all():  # texts that either tokenizer changes have no tokens
            keep = sound[doc]
            self.a, self.b = self.a[np.repeat(keep, size_a)], self.b[np.repeat(keep, size_b)]
            start, doc, size_a, size_b = start[keep], doc[keep], size_a[keep], size_b[keep]
        ends_a, ends_b = np.cumsum(pair.bytes_a.size[self.a]), np.cumsum(pair.bytes_b.size[self.b])
        self.reach_a, self.reach_b = np.append(0, np.cumsum(size_a)), np.append(0, np.cumsum(size_b))
        lane = np.flatnonzero(C.changes(doc, (start - off[doc]) // LANE_BYTES))
        edge = np.append(lane, len(start))
        self.group_a, self.group_b = run_groups(ends_a, ends_b, self.reach_a[edge[:-1]], self.reach_a[edge[1:]], self.reach_b[edge[:-1]], self.reach_b[edge[1:]])
        by_doc = np.searchsorted(doc, np.arange(n + 1))
        self.doc_a, self.doc_b = self.reach_a[by_doc], self.reach_b[by_doc]  # offsets of each text's tokens
        self.doc_group = np.searchsorted(self.group_a, self.doc_a)  # and groups
        self.size_a, self.size_b = np.diff(np.append(self.group_a, len(self.a))), np.diff(np.append(self.group_b, len(self.b)))
        self.n_links = np.diff(np.append(0, np.cumsum(self.size_a * self.size_b))[self.doc_group])

    def digests(self, keep: bool) -> tuple[list, list]:
        """(hash of the groups as text, that text if kept else None) of each text."""
        comma, bar, semicolon = decimals(max(self.a.max(initial=0), self.b.max(initial=0)) + 1)
        group = np.arange(len(self.group_a))
        of_a, of_b = np.repeat(group, self.size_a), np.repeat(group, self.size_b)
        # A's tokens of a group stand before B's
        at_a = np.arange(len(self.a)) + self.group_b[of_a] if len(group) else of_a
        at_b = np.arange(len(self.b)) + np.append(self.group_a, len(self.a))[of_b + 1] if len(group) else of_b
        text = np.empty(len(self.a) + len(self.b), object)
        text[at_a], text[at_b] = comma[self.a], comma[self.b]
        last = np.append(self.group_a[1:], len(self.a)) - 1
        text[at_a[last]] = bar[self.a[last]]
        last = np.append(self.group_b[1:], len(self.b)) - 1
        text[at_b[last]] = semicolon[self.b[last]]
        edges = (self.doc_a + self.doc_b).tolist()
        whole = [b"".join(text[i:j].tolist())[:-1] for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return [hashlib.sha256(w).hexdigest() if w else "" for w in whole], [w.decode() if keep else None for w in whole]

    def linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair's code, how many links) of each text's distinct pairs, ascending."""
        doc = np.repeat(np.arange(len(self.doc_group) - 1), np.diff(self.doc_group))
        large = (self.size_a > LARGE_GROUP) | (self.size_b > LARGE_GROUP)
        parts = []
        na, nb = self.size_a[~large], self.size_b[~large]
        links = na * nb
        within = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        wide = np.repeat(nb, links)
        a = self.a[np.repeat(self.group_a[~large], links) + within // wide] if len(within) else within
        b = self.b[np.repeat(self.group_b[~large], links) + within % wide] if len(within) else within
        parts.append((np.repeat(doc[~large], links), a.astype(np.int64) * IDS + b, np.ones(len(a), np.int64)))
        for g in np.flatnonzero(large).tolist():
            a, times_a = np.unique(self.a[self.group_a[g] : self.group_a[g] + self.size_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[self.group_b[g] : self.group_b[g] + self.size_b[g]], return_counts=True)
            pairs = (a[:, None].astype(np.int64) * IDS + b[None, :]).ravel()
            parts.append((np.full(len(pairs), doc[g]), pairs, np.outer(times_a, times_b).ravel()))
        doc, code, times = (np.concatenate(p) for p in zip(*parts, strict=True))
        key = doc * (IDS * IDS) + code  # a chunk has fewer than 2**23 texts
        if len(parts) == 1:
            key, times = np.unique(key, return_counts=True)
        else:
            key, place = np.unique(key, return_inverse=True)
            added = np.zeros(len(key), np.int64)
            np.add.at(added, place, times)
            times = added
        return *np.divmod(key, IDS * IDS), times


_decimals: list = []


def decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """0..n-1 as decimal text followed by a comma, a bar, a semicolon."""
    if not _decimals or len(_decimals[0]) < n:
        texts = [str(i).encode() for i in range(n)]
        _decimals[:] = [np.array([t + mark for t in texts], object) for mark in (b",", b"|", b";")]
    return tuple(_decimals)


def pack_pairs(doc: np.ndarray, code: np.ndarray, times: np.ndarray) -> bytes | None:
    """A chunk's pairs, ascending by text and code, as a blob."""
    if not len(code):
        return None
    distinct, place = np.unique(code, return_inverse=True)
    parts = C.packed(np.diff(distinct, prepend=0)), C.packed(np.diff(doc * len(distinct) + place, prepend=0)), C.packed(times.astype(np.int64))
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_pairs(blob: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, text, place among the distinct codes, how many links)."""
    if blob is None:
        return (np.zeros(0, np.int64),) * 4
    parts, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        parts.append(C.unpacked(blob[at + 8 : at + 8 + size], "i8")[0])
        at += 8 + size
    distinct = np.cumsum(parts[0])
    return distinct, *np.divmod(np.cumsum(parts[1]), len(distinct)), parts[2]


CHUNKS = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>, pairs binary"


def align_partition(path_a: str, path_b: str, keep: bool) -> Callable:
    def run(batches):
        segments, number = Segments(loaded(path_a, path_b)), TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = C.text_buffer(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in C.chunks(off):
                chunk = Aligned(data[off[i] : off[j]], off[i : j + 1] - off[i], segments)
                doc, code, times = chunk.linked()
                sha, groups = chunk.digests(keep)
                blob = pack_pairs(doc, code, times)
                columns = [[number], [ids.slice(i, j - i).to_pylist()], *([np.diff(x).tolist()] for x in (chunk.doc_a, chunk.doc_b, chunk.doc_group)), [chunk.n_links.tolist()], [sha], [groups], [blob]]
                kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, *[pa.list_(pa.string())] * 2, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])
                number += 1

    return run


def merged_counts(parts: list) -> list:
    pair, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    docs = np.zeros(len(pair), np.int64)
    np.add.at(docs, place, np.concatenate([p[1] for p in parts]))
    return [(pair, docs)]


def count_partition(batches):
    """In how many documents of the partition each pair is linked; a pair may be in several rows."""
    parts, size = [], 0
    for batch in batches:
        for blob in batch.column("pairs"):
            distinct, _, place, _ = unpack_pairs(blob.as_py())
            if len(distinct):
                parts.append((distinct, np.bincount(place)))
                size += len(distinct)
            if size > COUNTED:
                parts = merged_counts(parts)
                size = len(parts[0][0])
                if size > COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["pair", "docs"])
                    parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged_counts(parts)[0]], ["pair", "docs"])


SETTLED = "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string, rest array<struct<pair:long,times:long>>"


def settle_partition(known) -> Callable:
    """Sums over each document's links of what is known of their pairs (pairs ascending, documents, best); the others are
    its rest."""

    def run(batches):
        pairs, docs, best = known.value
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["doc_id"])
                distinct, doc, place, times = unpack_pairs(row["pairs"])
                at = np.searchsorted(pairs, distinct)
                at[at == len(pairs)] = 0
                found = pairs[at] == distinct if len(pairs) else np.zeros(len(distinct), bool)
                edge = np.searchsorted(doc, np.arange(n + 1))
                of_doc = lambda x: np.diff(np.append(0, np.cumsum(x))[edge]).tolist()
                worth = np.where(found, docs[at], 0) if len(pairs) else at
                top = found & best[at] if len(pairs) else found
                rest = [None] * n
                if not found.all():
                    code = distinct[place]
                    for d in np.unique(doc[~found[place]]).tolist():
                        mine = slice(edge[d], edge[d + 1])
                        out = ~found[place[mine]]
                        rest[d] = [{"pair": p, "times": t} for p, t in zip(code[mine][out].tolist(), times[mine][out].tolist(), strict=True)]
                columns = [[row["chunk"]] * n, list(range(n)), *(row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), of_doc(times * top[place]), of_doc(times * worth[place]), row["groups_sha256"], row["groups"], rest]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SETTLED.split(", ")])

    return run


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (A's id * IDS + B's id), docs (documents that hold it linked), best (no pair of its A id has more)."""
    counts = chunks.select("pairs").mapInArrow(count_partition, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = C.written(counts.withColumn("a", F.floor(F.col("pair") / IDS)))
    most = F.broadcast(counts.groupBy("a").agg(F.max("docs").alias("most")))  # a row for each of A's ids
    return C.written(counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Aligns the tokens of a byte-level tokenizer (path_a, a file of the tokenizers library) with those of a sentencepiece
    model that puts a space before a text (path_b); both files are there on every machine.

    docs: doc_id, text; others ignored. Returns documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 and groups, the text `a1,a2|b1;...` if keep_groups, else null) and pair counts (pair = A's id * IDS + B's
    id, docs, best). Texts null, empty, or that the tokens of either tokenizer don't join to again have no tokens: zeros and
    empty text. Null ids and repeated rows: documents like others, each counts. No documents: no rows.

    Counts of the broadcast_pairs commonest pairs are broadcast; those of all others are joined. So a pair that many
    documents hold is never a key of that join.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunks = C.written(rows.mapInArrow(align_partition(path_a, path_b, keep_groups), CHUNKS))
    counts = pair_counts(chunks)
    n = counts.count()
    top = counts if n <= broadcast_pairs else counts.orderBy(F.desc("docs"), "pair").limit(broadcast_pairs)
    top = top.toArrow()
    pairs, documents, best = (top.column(c).to_numpy() for c in ("pair", "docs", "best"))
    order = np.argsort(pairs)
    known = spark.sparkContext.broadcast((pairs[order], documents[order], best[order].astype(bool)))
    settled = chunks.mapInArrow(settle_partition(known), SETTLED)
    if n > broadcast_pairs:
        settled = C.written(settled)
        rest = settled.select("chunk", "place", F.inline("rest")).join(counts, "pair")
        more = rest.groupBy("chunk", "place").agg(F.sum(F.col("times") * F.col("docs")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
        settled = settled.join(more, ["chunk", "place"], "left").withColumns({"n_best": add("n_best", "more_best"), "count_sum": add("count_sum", "more")})
    return settled.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"), counts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0].drop("groups")
