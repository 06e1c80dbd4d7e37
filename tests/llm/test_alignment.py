"""Alignment of tokenizers against the meeting ends of whole texts, text by text."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from retentia.llm import alignment

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def tokens(text):
    """(A's ids and ends, B's ids and ends) of a whole text, or none."""
    pair, none = alignment.loaded(*PATHS), ([], [], [], [])
    if not text:
        return none
    whole = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    token = lambda t, i: t.take(np.array([i]))[0].tobytes()
    bytes_a, bytes_b = [token(pair.bytes_a, i) for i in a], [token(pair.bytes_b, i) for i in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return none
    return a, np.cumsum([len(x) for x in bytes_a]).tolist(), b, np.cumsum([len(x) for x in bytes_b]).tolist()


def groups(text):
    a, ends_a, b, ends_b = tokens(text)
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((a[i:p], b[j:q]))
        i, j = p, q
    return out


def force(texts):
    found, docs = [], Counter()
    for t in texts:
        g = groups(t)
        links = Counter((x, y) for a, b in g for x in a for y in b)
        docs.update(links.keys())
        found.append((g, links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    rows = []
    for g, links in found:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for p, n in links.items() if docs[p] == most[p[0]])
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()), best, sum(n * docs[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest() if g else "", written))
    return rows


def odd_texts():
    rng = random.Random(13)
    letters = [*"abcdE é😀   \n\t.,'0１3ſß▁ 　日本<>s/|\x00’", " the", " ing", "'s ", "  ", "Word.\nNext", "e, f"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["<|endoftext|>", "<s> </s>", " lead", "trail ", "\n", " ", "a", "a b", "x. y", "é. é", None, "", "a\x00b"]
    texts += ["the same words again. " * 900, "z" * 3000, "日本語" * 400]
    return texts + ["repeated row. Again"] * 5


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    rows = [(i % 500 if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk int, pairs string").repartition(4), Counter((rows[i][0], *f) for i, f in enumerate(force(texts)))


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 40, 0])
def test_odd_texts_with_and_without_broadcast_counts(odd, broadcast_pairs):
    docs, want = odd
    rows = alignment.align(docs, *PATHS, keep_groups=True, broadcast_pairs=broadcast_pairs)[0].collect()
    assert Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in rows) == want


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((d.doc_id, *f[:-1]) for d, f in zip(docs, force([d.text for d in docs]), strict=True))
    rows = alignment.query(spark, sf).collect()
    assert Counter((r.doc_id, *(r[f] for f in FIELDS[:-1])) for r in rows) == want


def test_no_documents(spark, no_documents):
    rows, counts = alignment.align(no_documents, *PATHS)
    assert rows.count() == 0 and counts.count() == 0


def test_runs_are_skipped_and_groups_found():
    """Lanes with long one-to-one stretches, shifts and irregular ends, against a set of ends."""
    rng = np.random.default_rng(1)
    a, b, edges, want = [], [], [(0, 0)], []
    at = 0
    for _ in range(60):
        size = int(rng.integers(1, 300))
        ends = at + np.cumsum(rng.integers(1, 4, size))
        drop = rng.choice([0.0, 0.02, 0.6])
        left, right = ends[rng.random(size) >= drop], ends[rng.random(size) >= drop]
        left, right = np.union1d(left, ends[-1:]), np.union1d(right, ends[-1:])
        common = np.intersect1d(left, right)
        want += [(len(a) + int(np.searchsorted(left, c, "right")), len(b) + int(np.searchsorted(right, c, "right"))) for c in [at, *common[:-1]]]
        a += left.tolist()
        b += right.tolist()
        edges.append((len(a), len(b)))
        at = int(ends[-1])
    e = np.array(edges)
    found = alignment.run_groups(np.array(a), np.array(b), e[:-1, 0], e[1:, 0], e[:-1, 1], e[1:, 1])
    assert list(zip(found[0].tolist(), found[1].tolist(), strict=True)) == want


def test_pairs_of_large_groups(monkeypatch):
    """Made of distinct ids, they are what single links add up to."""
    pair = alignment.loaded(*PATHS)
    texts = [t for t in odd_texts() if t]
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(r) for r in raw]))
    chunk = alignment.Aligned(np.frombuffer(b"".join(raw), np.uint8), off, alignment.Segments(pair))
    plain = [x.tolist() for x in chunk.linked()]
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    assert [x.tolist() for x in chunk.linked()] == plain
    blob = alignment.pack_pairs(*chunk.linked())
    distinct, doc, place, times = alignment.unpack_pairs(blob)
    assert [doc.tolist(), distinct[place].tolist(), times.tolist()] == plain
