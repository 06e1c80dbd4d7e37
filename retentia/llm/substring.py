"""Substring dedup: words covered by a 35-word passage that also stands elsewhere are removed, every copy of them.

Reference shards are passages of the corpus itself, dealt out by their anchors (windows.py); of each shard a suffix
automaton is built, the shard's passages are streamed through it for matching statistics over what occurs at least
twice, and spans of at least the threshold are removed. The automata are not broadcast: a reference as large as the
corpus would make every executor hold, and every document pass, all of it. Equal passages have equal anchors, so a
shard meets all it can match, and the work grows with the corpus and not with its square.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import windows as W

WIDTH = 35
#: Words of passages under one automaton; a group of passages with one anchor stays whole.
SHARD_WORDS = 40_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


class SuffixAutomaton:
    """Of several passages; knows which of their substrings occur at least twice (as ends of occurrences)."""

    def __init__(self, passages: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, count = [-1], [0], [0]
        nxt, link, length = self.next, self.link, self.length
        for passage in passages:
            last = 0
            for x in passage:
                q = nxt[last].get(x)
                if q is not None and length[q] == length[last] + 1:  # an earlier passage brought this state
                    last = q
                    count[q] += 1
                    continue
                if q is None:
                    new = len(nxt)
                    nxt.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    count.append(1)
                    p = last
                    while p != -1 and x not in nxt[p]:
                        nxt[p][x] = new
                        p = link[p]
                    last = new
                    if p == -1:
                        continue
                    q = nxt[p][x]
                    if length[q] == length[p] + 1:
                        link[new] = q
                        continue
                else:
                    new, p = -1, last
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                count.append(0)
                while p != -1 and nxt[p].get(x) == q:
                    nxt[p][x] = clone
                    p = link[p]
                link[q] = clone
                if new < 0:
                    last = clone
                    count[clone] += 1
                else:
                    link[new] = clone
        for v in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
            if link[v] > 0:
                count[link[v]] += count[v]
        self.repeated = [c > 1 for c in count]

    def matching_statistics(self, passage: list[int]) -> list[int]:
        """At each position the length of the longest repeated substring that ends there."""
        nxt, link, length, repeated = self.next, self.link, self.length, self.repeated
        v = size = 0
        out = []
        for x in passage:
            while True:
                q = nxt[v].get(x)
                if q is not None and repeated[q]:
                    v, size = q, size + 1
                    break
                if v == 0:
                    size = 0
                    break
                v = link[v]
                size = length[v]
            out.append(size)
        return out


def automaton_resolver(spec: W.Spec):
    def resolve(values, off, k, start, at, rep):
        doc, _, _, anchor, _ = W.runs_of(C.Prefix(values), off, spec)
        of = np.zeros(len(off) - 1, np.uint64)
        of[doc] = anchor
        order = np.argsort(of, kind="stable")
        size = np.diff(off)[order]
        new = C.changes(of[order])
        group = np.cumsum(new) - 1
        total = np.cumsum(np.bincount(group, weights=size)) if len(group) else np.zeros(0)
        shard = (total // SHARD_WORDS)[group]
        _, small = np.unique(values, return_inverse=True)
        hit = np.zeros(len(at), bool)
        first = np.searchsorted(rep, np.arange(len(off) - 1))
        edges = np.flatnonzero(np.append(C.changes(shard), True))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            passages = [small[off[r] : off[r + 1]].tolist() for r in order[a:b]]
            automaton = SuffixAutomaton(passages)
            for r, passage in zip(order[a:b], passages, strict=True):
                stats = np.array(automaton.matching_statistics(passage)[spec.width - 1 :])
                hit[first[r] : first[r] + len(stats)] = stats >= spec.width
        return hit

    return resolve


def _finish(width: int):
    def run(batches):
        for batch in batches:
            words, removed, texts, digests = [], [], [], []
            for text, (lo, hi) in zip(batch.column("text").to_pylist(), W.removed_stretches(batch, width), strict=True):
                own = (text or "").encode().split()
                words.append(len(own))
                removed.append(int((hi - lo).sum()))
                if len(lo):
                    ends, starts = [0, *hi.tolist()], [*lo.tolist(), len(own)]
                    own = [w for a, b in zip(ends, starts, strict=True) for w in own[a:b]]
                kept = b" ".join(own)
                texts.append(kept.decode())
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return run


def remove_repeated_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Removes each word that a window of `width` words covers whose words also start anywhere else (any document, the same
    one too). docs: doc_id, text, others ignored. Returns a row per document: doc_id, n_words, n_removed, kept_text (words
    that stay, joined by one space), kept_sha256.

    Null text: no words. Null doc_id: a document like others. Rows with one doc_id: each its own document, so repeats of a
    row remove each other. Under `width` words: nothing is removed. No documents: no rows.
    """
    spec = W.Spec(words=True, width=width, spread=max(1, width * 24 // 35), any_place=True)
    return W.repeated(docs, spec, automaton_resolver(spec), _finish(width), SCHEMA, [])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
