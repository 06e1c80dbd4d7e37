"""Near-duplicate components against all pairs of a small corpus."""

from collections import Counter

import numpy as np
import pytest

from retentia.llm import minhash

LEAST = -(2**63)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=2):
    w = (text or "").translate(LOW).encode().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain(corpus):
    """Rows whose sets share their smallest id are one node."""
    sets = [shingles(t) for _, t in corpus]
    ids = [LEAST if d is None else d for d, _ in corpus]
    least = {}
    for k, s in zip(ids, sets, strict=True):
        least[s] = min(least.get(s, k), k)
    comp = {k: k for k in least.values()}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    some = [s for s in least if s]
    for i, a in enumerate(some):
        for b in some[:i]:
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both) and both:
                x, y = root(least[a]), root(least[b])
                comp[max(x, y)] = min(x, y)
    null = lambda k: None if k == LEAST else k
    return Counter((null(k), len(s), null(root(least[s]) if s else k), (root(least[s]) if s else k) == k) for k, s in zip(ids, sets, strict=True))


def test_components(documents, corpus):
    rows = minhash.near_duplicates(documents).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == plain(corpus)


def test_chain_in_one_bucket(spark):
    """Neighbours in a chain are similar and its ends aren't, so a star around one member doesn't find all links."""
    docs = [(i, " ".join(f"t{j}" for j in range(i * 6, i * 6 + 90))) for i in range(14)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = minhash.near_duplicates(df, rows=1, bands=40)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == plain(docs)


def test_stars_of_small_cells(documents, corpus, monkeypatch):
    """With several levels of centres, and blocks of few documents."""
    monkeypatch.setattr(minhash, "CELL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = minhash.near_duplicates(documents).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == plain(corpus)


def test_rows_are_picked_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (3, c, "x"), (3, c, "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is null or not (doc_id = 2 and k = 'y')").collect()))


def test_empty(no_documents):
    assert minhash.near_duplicates(no_documents).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.sort(np.concatenate([a[:2400], rng.integers(0, 2**63, 600).astype(np.uint64)]))
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 3000, 6000]), 1, 400)
    assert (s[0] == s[1]).mean() == pytest.approx(2400 / 3600, abs=0.08)


def test_one_of_each_stays(documents):
    kept = minhash.keep_one_of_each(documents)
    assert kept.columns == documents.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 103 not in ids and {500, 501, 700} <= ids
