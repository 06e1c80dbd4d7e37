"""Repeated byte strings and word passages against plain versions."""

import hashlib
from collections import Counter

import pytest

from retentia.llm import substring, suffix_array, windows

LEAST = -(2**63)


def plain_bytes(corpus, width):
    first = {}
    order = [(LEAST if d is None else d, (t or "").encode()) for d, t in corpus]
    for k, raw in order:
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            first[w] = min(first.get(w, (k, s)), (k, s))
    out = []
    for (d, _), (k, raw) in zip(corpus, order, strict=True):
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            if first[raw[s : s + width]] < (k, s):
                gone[s : s + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def plain_words(corpus, width):
    own = [(t or "").encode().split() for _, t in corpus]
    seen = Counter(tuple(w[s : s + width]) for w in own for s in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(corpus, own, strict=True):
        gone = bytearray(len(w))
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = b"\1" * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [2000, 1])
def test_bytes(documents, corpus, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT_ANCHOR", hot)
    rows = suffix_array.remove_repeated_bytes(documents, 100).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows)
    assert got == plain_bytes(corpus, 100)


@pytest.mark.parametrize("hot", [2000, 1])
def test_words(documents, corpus, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT_ANCHOR", hot)
    rows = substring.remove_repeated_words(documents, 35).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == plain_words(corpus, 35)


def test_automaton_counts_and_statistics():
    automaton = substring.SuffixAutomaton([[1, 2, 3, 4], [2, 3, 4, 5], [9]])
    assert automaton.matching_statistics([1, 2, 3, 4]) == [0, 1, 2, 3]
    assert automaton.matching_statistics([9, 2, 3, 7, 4]) == [0, 1, 2, 0, 1]
    same = substring.SuffixAutomaton([[1, 1, 1]])
    assert same.matching_statistics([1, 1, 1, 1]) == [1, 2, 2, 2]


def test_empty(no_documents):
    assert suffix_array.remove_repeated_bytes(no_documents).count() == 0
    assert substring.remove_repeated_words(no_documents).count() == 0


def test_passages_are_cut_out_of_documents(documents):
    out = suffix_array.drop_repeated_passages(documents.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert [f for f in out[0].__fields__] == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in out}
    assert 100 in ids or 200 in ids
    assert {500, 501, 502, 503} <= ids  # untouched, so they stay as they are
    assert 105 not in ids  # a copy: nothing is left
    assert all(r.n_chars == len(r.text or "") for r in out)
