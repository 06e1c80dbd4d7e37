"""Repeated windows of a corpus, found without shuffling every window.

A window is W consecutive symbols (bytes or words) of one document. Its anchor is the K-gram of least hash in it, a
function of the window's content alone, so equal windows have equal anchors. Consecutive windows with one anchor form a
*run*; a run is a suffix of the text whose leading tokens are the hash of the anchor and the hash of the whole run.

1. Each task finds its runs, settles those that are equal within the task, and deals one of each out by sampled
   splitters over (anchor, run); settled rows go to any bucket and pass through. Equal runs that aren't settled meet in
   one bucket. A bucket sorts its runs and settles those that are equal as a whole. Runs that share only an anchor may
   share some windows; these few are *open*.
2. The content of open runs is fetched from their documents and dealt out by anchor again, and a resolver (a suffix sort
   for bytes, suffix automata for words) tells which windows repeat. Open runs of an anchor that is cut by a splitter
   or very frequent are compared window by window instead, dealt by a 128-bit fingerprint of the window, so that no
   task gets a hot anchor as a whole.

Only fingerprints, the few open passages and intervals are shuffled, beside the documents themselves (once).
Positions are ordered by (doc_id, start); a null doc_id is the smallest. Rows with one doc_id are distinct documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
#: Open runs of one anchor beyond which windows are compared by fingerprint.
HOT_ANCHOR = 2000
#: Runs that a task settles among themselves before they are dealt out; bounds a worker's memory.
SETTLED = 200_000
#: Settled rows that go to one bucket together.
SETTLED_ROWS = 1000
#: Documents from which splitters are drawn.
SPLITTER_DOCS = 3000
#: Bytes of text for each bucket: what a task sorts and resolves at once is in proportion, whatever the corpus' size.
BUCKET_BYTES = 4 << 20
CLOSED, OPEN, HOT = 0, 1, 2
RUNS = "part int, blob binary"
SPANS = "k long, tag long, start int, n int, kind int, part int"
KINDS = ("<u8", "<u8", "<i8", "<u4", "<i4", "<u2", "u1")


@dataclass(frozen=True)
class Spec:
    """words: symbols are words, else bytes. width: of a window. spread: K-grams in a window. any_place: a window counts
    as repeated if it starts anywhere else, else only if it starts earlier."""

    words: bool
    width: int
    spread: int
    any_place: bool

    @property
    def gram(self) -> int:
        return self.width - self.spread + 1


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: -(width - have)], v[width - have :]) if have < width else v


def runs_of(prefix: C.Prefix, off: np.ndarray, spec: Spec):
    """(document, start, windows, anchor hash, run hash) of all runs of a buffer of documents."""
    n, k = len(prefix.sums) - 1, spec.gram
    first, end = off[:-1], off[1:] - spec.width + 1
    full = end > first
    if n < spec.width or not full.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64), z.astype(U64)
    h = C.splitmix(prefix.of_width(k))
    v = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    at = (sliding_min(v, spec.spread) & U64(0xFFFFFFFF)).astype(np.int64)
    new = C.changes(at)
    new[first[full]] = True
    e = end[full]
    new[e[e < len(at)]] = True
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(at))
    doc = np.searchsorted(off, s, "right") - 1
    keep = s < end[doc]
    s, e, doc = s[keep], e[keep], doc[keep]
    a = at[s]
    run = C.splitmix(prefix.of(s, e - 1 + spec.width) ^ ((a - s).astype(U64) * U64(0xA0761D6478BD642F)))
    return doc, s - off[doc], e - s, h[a], run


def symbols(data: np.ndarray, off: np.ndarray, spec: Spec) -> tuple[C.Prefix, np.ndarray]:
    if not spec.words:
        return C.Prefix(C.BYTE_VALUES[data]), off
    h, _, _, woff = C.word_hashes(data, off)
    return C.Prefix(h), woff


def batch_runs(batch: pa.RecordBatch, spec: Spec):
    """For the chunks of a batch: (k, tag, start, windows, anchor, run)."""
    data, off = C.text_buffer(batch.column("text"))
    k, tag = batch.column("k").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False)
    for i, j in C.chunks(off):
        piece = off[i : j + 1] - off[i]
        doc, start, n, anchor, run = runs_of(*symbols(data[off[i] : off[j]], piece, spec), spec)
        yield k[i:j][doc], tag[i:j][doc], start, n, anchor, run


def splitters(docs: DataFrame, spec: Spec, n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled splitters over (anchor, run): parts - 1 of them, from n documents. They steer sizes alone, never results."""

    def sample(batches):
        for batch in batches:
            for *_, anchor, run in batch_runs(batch, spec):
                some = (run & U64(7)) == 0
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([C.packed(anchor[some], run[some])], pa.binary())], ["part", "blob"])

    drawn = docs.sample(False, min(1.0, SPLITTER_DOCS / max(n, 1)), 7).limit(2 * SPLITTER_DOCS).mapInArrow(sample, RUNS).select("blob").collect()
    pairs = [C.unpacked(r.blob, "<u8", "<u8") for r in drawn]
    anchor, run = (np.concatenate([p[x] for p in pairs]) if pairs else np.zeros(0, U64) for x in (0, 1))
    if len(anchor) < parts:
        return (np.arange(1, parts, dtype=U64) * U64(2**64 // parts)), np.zeros(parts - 1, U64)
    order = np.lexsort((run, anchor))
    cut = order[(np.arange(1, parts) * len(order)) // parts]
    return anchor[cut], run[cut]


def bucket_of(anchor: np.ndarray, run: np.ndarray, cut_anchor: np.ndarray, cut_run: np.ndarray) -> np.ndarray:
    """How many splitters are not above (anchor, run)."""
    lo = np.searchsorted(cut_anchor, anchor, "left")
    out = lo.copy()
    equal = lo < np.searchsorted(cut_anchor, anchor, "right")
    for a in np.unique(anchor[equal]):
        i, j = np.searchsorted(cut_anchor, a, "left"), np.searchsorted(cut_anchor, a, "right")
        rows = equal & (anchor == a)
        out[rows] = i + np.searchsorted(cut_run[i:j], run[rows], "right")
    return out.astype(np.int64)


def settle(anchor, run, k, start, weight, any_place):
    """Sorts runs by (anchor, run, k, start). Returns the order and, in it: closed (all windows of the run repeat by what
    is known here), first of its (anchor, run), group numbers by (anchor, run) and by anchor, and group weights."""
    order = C.multikey_quicksort([anchor, run, k, start])
    anchor, run, k, start, weight = anchor[order], run[order], k[order], start[order], weight[order]
    first = C.changes(anchor, run)
    by_anchor = np.cumsum(C.changes(anchor)) - 1
    by_run = np.cumsum(first) - 1
    total = np.bincount(by_run, weights=weight, minlength=1)[by_run] if len(order) else np.zeros(0)
    if any_place:
        closed = total > 1
    else:  # a row is closed if an earlier place holds its run; equal (k, start) are copies of one row
        head = np.flatnonzero(first)
        closed = (k != k[head][by_run]) | (start != start[head][by_run]) if len(order) else np.zeros(0, bool)
    return order, closed, first, by_run, by_anchor, total


def find_runs(spec: Spec, cut_anchor, cut_run):
    def dealt(got):
        anchor, run_, k, tag, start, n = (np.concatenate(c) for c in zip(*got, strict=True))
        got.clear()
        order, closed, first, _, _, total = settle(anchor, run_, k, start, np.ones(len(k)), spec.any_place)
        anchor, run_, k, tag, start, n = (c[order] for c in (anchor, run_, k, tag, start, n))
        # one of each run goes on, with equal (k, start) of repeated rows beside it; the others are settled and pass through
        state = np.where(closed & ~first, 0, np.minimum(total, 2)).astype(np.uint8)
        done = state == 0
        # a common run has a settled row for each copy: these are dealt by place, not with their run
        zero, parts = np.zeros(done.sum(), U64), len(cut_anchor) + 1
        settled = (zero, zero, *(c[done] for c in (k, tag, start, n, state)))
        for i in range(0, len(zero), SETTLED_ROWS):
            rows = [c[i : i + SETTLED_ROWS] for c in settled]
            b = int(C.splitmix(C.splitmix(rows[2][:1].astype(np.int64).view(U64)) ^ rows[4][:1].astype(U64))[0] % U64(parts))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([C.packed(*rows)], pa.binary())], ["part", "blob"])
        anchor, run_, k, tag, start, n, state = (c[~done] for c in (anchor, run_, k, tag, start, n, state))
        bucket = bucket_of(anchor, run_, cut_anchor, cut_run)  # ascending, as the runs are sorted
        edge = np.searchsorted(bucket, np.arange(parts + 1))
        for b in np.flatnonzero(edge[1:] > edge[:-1]):
            r = slice(edge[b], edge[b + 1])
            blob = C.packed(anchor[r], run_[r], k[r], tag[r], start[r], n[r], state[r])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])

    def run(batches):
        got, size = [], 0
        for batch in batches:
            for k, tag, start, n, anchor, run_ in batch_runs(batch, spec):
                got.append((anchor, run_, k, tag.astype(np.uint32), start.astype(np.int32), n.astype(np.uint16)))
                size += len(k)
                if size >= SETTLED:
                    yield from dealt(got)
                    size = 0
        if got:
            yield from dealt(got)

    return run


def spans_batch(k, tag, start, n, kind, part) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(k, pa.int64()),
            pa.array(tag.astype(np.int64)),
            pa.array(start.astype(np.int32)),
            pa.array(n.astype(np.int32)),
            pa.array(kind.astype(np.int32)),
            pa.array(part.astype(np.int32)),
        ],
        ["k", "tag", "start", "n", "kind", "part"],
    )


def in_slices(batch: pa.RecordBatch, most: int = 50_000):
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def sort_buckets(spec: Spec, cut_anchor, cut_run):
    def run(batches):
        got = []
        for batch in batches:
            for blob in batch.column("blob"):
                row = C.unpacked(blob.as_py(), *KINDS)
                done = row[-1] == 0
                if done.any():  # settled: these pass through and aren't held
                    _, _, k, tag, start, n, _ = (c[done] for c in row)
                    yield from in_slices(spans_batch(k, tag, start, n, np.full(len(k), CLOSED), np.zeros(len(k))))
                if not done.all():
                    got.append([c[~done] for c in row])
        if not got:
            return
        anchor, run_, k, tag, start, n, state = (np.concatenate(c) for c in zip(*got, strict=True))
        del got
        order, closed, first, by_run, by_anchor, _ = settle(anchor, run_, k, start, state.astype(float), spec.any_place)
        anchor, run_, k, tag, start, n = (c[order] for c in (anchor, run_, k, tag, start, n))
        # runs of an anchor that has several are open; at a bucket's border the anchor may go on in the next one
        kinds = np.bincount(by_anchor, weights=first, minlength=1)[by_anchor] if len(k) else np.zeros(0)
        cut = np.isin(anchor, cut_anchor)
        hot = cut | (kinds > HOT_ANCHOR)
        open_ = ((kinds > 1) | cut) & (first | ~closed)
        bucket = bucket_of(anchor, run_, cut_anchor, cut_run)
        if closed.any():
            yield from in_slices(spans_batch(*(c[closed] for c in (k, tag, start, n)), np.full(closed.sum(), CLOSED), np.zeros(closed.sum())))
        if open_.any():
            yield from in_slices(spans_batch(*(c[open_] for c in (k, tag, start, n)), np.where(hot[open_], HOT, OPEN), bucket[open_]))

    return run


def list_columns(batch: pa.RecordBatch, name: str, *fields: str):
    """Offsets and flat numpy columns of a list<struct> column; null: empty."""
    column = batch.column(name)
    lengths = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    flat = column.flatten()
    off = np.append(0, np.cumsum(lengths))
    return off, [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


OPENED = "part int, kind int, blob binary"


def fetch_open(spec: Spec, parts: int):
    """The symbols of open runs (or the fingerprints of their windows, for hot anchors), by the bucket they go to."""

    def run(batches):
        for batch in batches:
            data, off = C.text_buffer(batch.column("text"))
            k, tag = batch.column("k").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False)
            loff, (start, n, kind, part) = list_columns(batch, "spans", "start", "n", "kind", "part")
            for i, j in C.chunks(off):
                s = slice(loff[i], loff[j])
                keep = np.flatnonzero(kind[s] != CLOSED) + loff[i]
                if not len(keep):
                    continue
                doc = np.searchsorted(loff, keep, "right") - 1
                piece = data[off[i] : off[j]]
                if spec.words:
                    values, _, _, woff = C.word_hashes(piece, off[i : j + 1] - off[i])
                else:
                    values, woff = piece, off[i : j + 1] - off[i]
                at = woff[doc - i] + start[keep]
                for want in (OPEN, HOT):
                    m = kind[keep] == want
                    if not m.any():
                        continue
                    a, size, d, st, to = at[m], n[keep][m].astype(np.int64), doc[m], start[keep][m], part[keep][m].astype(np.int64)
                    if want == HOT:  # one row for each window, dealt by its fingerprint
                        rep = np.repeat(np.arange(len(a)), size)
                        step = np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size)
                        a, st, d = a[rep] + step, st[rep] + step, d[rep]
                        x = values if spec.words else C.BYTE_VALUES[values]
                        one, two = C.Prefix(x).of(a, a + spec.width), C.Prefix(C.splitmix(x + U64(99))).of(a, a + spec.width)
                        to = (one % U64(parts)).astype(np.int64)
                        cols = (one, two, k[d], tag[d].astype(np.uint32), st.astype(np.int32))
                    else:
                        cols = (k[d], tag[d].astype(np.uint32), st.astype(np.int32), size.astype(np.uint16))
                    by = np.argsort(to, kind="stable")
                    for b in np.unique(to):
                        r = by[np.searchsorted(to[by], b) : np.searchsorted(to[by], b, "right")]
                        blob = C.packed(*(c[r] for c in cols))
                        if want == OPEN:
                            lens = size[r] + spec.width - 1
                            rep = np.repeat(np.arange(len(r)), lens)
                            where = a[r][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(lens) - lens, lens)
                            head = len(blob).to_bytes(8, "little")
                            blob = head + blob + C.packed(values[where])
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([want], pa.int32()), pa.array([blob], pa.binary())], ["part", "kind", "blob"])

    return run


def resolve_open(spec: Spec, resolver: Callable):
    """resolver(values, off, k, start) -> mask over all windows, run after run, that repeat."""

    def run(batches):
        near, far = [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == HOT:
                    far.append(C.unpacked(blob, "<u8", "<u8", "<i8", "<u4", "<i4"))
                else:
                    cut = 8 + int.from_bytes(blob[:8], "little")
                    near.append((*C.unpacked(blob[8:cut], "<i8", "<u4", "<i4", "<u2"), C.unpacked(blob[cut:], "<u8" if spec.words else "u1")[0]))
        if near:
            k, tag, start, n, values = (np.concatenate(c) for c in zip(*near, strict=True))
            n = n.astype(np.int64)
            off = np.append(0, np.cumsum(n + spec.width - 1))
            rep = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            hit = resolver(values, off, k, start, off[rep] + step, rep)
            yield from window_spans(k[rep][hit], tag[rep][hit], (start[rep] + step)[hit])
        if far:
            one, two, k, tag, start = (np.concatenate(c) for c in zip(*far, strict=True))
            order, closed, *_ = settle(one, two, k, start, np.ones(len(k)), spec.any_place)
            rows = order[closed]
            yield from window_spans(k[rows], tag[rows], start[rows])

    return run


def window_spans(k, tag, start):
    """Windows as spans, neighbours joined."""
    order = np.lexsort((start, tag, k))
    k, tag, start = k[order], tag[order], start[order].astype(np.int64)
    if not len(k):
        return
    new = C.changes(k, tag)
    new[1:] |= start[1:] > start[:-1] + 1
    at = np.flatnonzero(new)
    last = start[np.append(at[1:], len(k)) - 1]
    yield from in_slices(spans_batch(k[at], tag[at], start[at], last - start[at] + 1, np.zeros(len(at)), np.zeros(len(at))))


def suffix_order_resolver(width: int):
    """Windows of bytes that also start earlier: multikey quicksort over 8-byte words of the suffixes that the windows lead."""

    def resolve(values, off, k, start, at, rep):
        text = np.append(values, np.zeros(8, np.uint8))
        words = np.zeros(len(values) + 1, U64)
        for b in range(8):
            words[:-1] = (words[:-1] << U64(8)) | text[b : b + len(values)]
        steps = [*range(0, width - 7, 8)] + ([width - 8] if width % 8 else [])
        pos = start[rep].astype(np.int64) + (at - off[rep])
        keys = [lambda rows, s=s: words[at[rows] + s] for s in steps]
        order = C.multikey_quicksort([*keys, lambda rows: k[rep[rows]], pos])
        first = np.zeros(len(order), bool)
        for key in keys:
            first |= C.changes(key(order))
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        ko, po = k[rep[order]], pos[order]
        hit = np.zeros(len(at), bool)
        hit[order] = (ko != ko[head]) | (po != po[head])
        return hit

    return resolve


def repeated(docs: DataFrame, spec: Spec, resolver: Callable, finish: Callable, schema, carry: list[str]) -> DataFrame:
    """finish(batches), with columns doc_id, text, *carry, spans and more (lists of start, n, kind), gives `schema`."""
    spark = docs.sparkSession
    C.small_batches(spark)
    keyed = C.keyed_documents(docs)
    n, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(C.partitions(spark), -(-size // BUCKET_BYTES))
    cut = splitters(keyed.select("k", "tag", "text"), spec, n, parts)
    found = keyed.select("k", "tag", "text").mapInArrow(find_runs(spec, *cut), RUNS)
    spans = found.repartitionById(parts, F.col("part")).mapInArrow(sort_buckets(spec, *cut), SPANS)
    lists = F.collect_list(F.struct("start", "n", "kind", "part"))
    by_doc = spans.groupBy("k", "tag").agg(lists.alias("spans"))
    dealt = C.keyed_documents(docs, carry).repartition("k", "tag")
    opened = (
        dealt.join(by_doc.hint("shuffle_hash"), ["k", "tag"])
        .select("k", "tag", "text", "spans", "doc_id", *carry)  # all columns, so that both joins read one exchange of the texts
        .mapInArrow(fetch_open(spec, parts), OPENED)
        .repartitionById(parts, F.col("part"))
        .mapInArrow(resolve_open(spec, resolver), SPANS)
    )
    more = opened.groupBy("k", "tag").agg(lists.alias("more"))
    return (
        dealt.join(by_doc.hint("shuffle_hash"), ["k", "tag"], "left")
        .join(more.hint("shuffle_hash"), ["k", "tag"], "left")
        .select("doc_id", "text", *carry, "spans", "more")
        .mapInArrow(finish, schema)
    )


def removed_stretches(batch: pa.RecordBatch, width: int):
    """For each document of a batch, the maximal stretches (lo, hi) of symbols that repeated windows cover."""
    soff, (s_start, s_n, s_kind) = list_columns(batch, "spans", "start", "n", "kind")
    moff, (m_start, m_n) = list_columns(batch, "more", "start", "n")
    for i in range(batch.num_rows):
        a = slice(soff[i], soff[i + 1])
        sure = s_kind[a] == CLOSED
        b = slice(moff[i], moff[i + 1])
        lo = np.concatenate([s_start[a][sure], m_start[b]]).astype(np.int64)
        hi = lo + np.concatenate([s_n[a][sure], m_n[b]]).astype(np.int64) - 1 + width
        yield C.merged(lo, hi)
