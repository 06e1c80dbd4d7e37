"""op2, op6, op8 and op10 over whole tables against plain versions: words one by one, pairs one by one, counters."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from retentia.llm import common as C
from retentia.llm import language, neighbours, quality, toxicity


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "pages", "embeddings")}


def test_toxicity_chain(spark, sf, tables):
    chain = toxicity.fit(tables["documents"], tables["labels"], toxicity.CATEGORIES)
    place = {int(h): i for i, h in enumerate(chain.vocabulary)}
    of_word = {}

    def hashes(word):
        if word not in of_word:
            of_word[word] = [int(h) for h in toxicity.features(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[1]]
        return of_word[word]

    rows = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    seen = 0
    for d in tables["documents"].collect():
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", lowered(d.text)))
        held = {place[h] for w in words for h in hashes(w) if h in place}
        earlier = []
        for w in chain.weights:
            z = sum(w[f] for f in sorted(held)) + sum(p * w[len(place) + i] for i, p in enumerate(earlier)) + w[-1]
            earlier.append(sigmoid(z))
        r = rows[d.doc_id]
        assert [r.p_junk, r.p_toxic] == pytest.approx(earlier, abs=1e-6)
        assert r.toxic == (r.p_toxic >= 0.5)
        seen += len(held) > 0
    assert seen > 0.5 * len(rows)


def test_quality_machine(spark, sf, tables):
    machine = quality.fit(tables["documents"], tables["labels"])
    bucket_of = {}

    def bucket(word):
        if word not in bucket_of:
            bucket_of[word] = int(C.word_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0]) % quality.BUCKETS
        return bucket_of[word]

    rows = {r.doc_id: r.score for r in quality.query(spark, sf).collect()}
    docs = tables["documents"].collect()
    assert len(rows) == len(docs)
    for d in docs:
        raw, low = (d.text or "").encode(), lowered(d.text)
        words = re.findall(rb"[^\x20\x09-\x0d]+", low)
        some, size, counts = max(len(words), 1), max(len(raw), 1), Counter(words)
        share = lambda pattern: len(re.findall(pattern, raw)) / size  # noqa: B023, E731
        x = defaultdict(float)
        for w, n in counts.items():
            x[bucket(w)] += n / some
        x = {k: math.sqrt(v) for k, v in x.items()}
        stats = [
            math.log1p(len(words)) / 8,
            math.log1p(sum(map(len, words)) / some),
            len(counts) / some,
            max(counts.values(), default=0) / some,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / some,
            3 * share(rb"[A-Z]"),
            3 * share(rb"[0-9]"),
            3 * share(rb"[.,;:!?'\"()-]"),
            3 * share(rb"[\x00-\x08\x0e-\x1b\x7f#$%&*+/<=>@\[\\\]^_`{|}~]"),
            share(rb"[\x80-\xff]"),
            2 * min(len(re.findall(rb"\n", raw)) / some, 1),
            math.log1p(max(d.n_chars or 0, 0)) / 10,
        ]
        x |= {quality.BUCKETS + i: v for i, v in enumerate(stats)}
        at = [k for k, v in x.items() if v]
        v = {k: machine.v[k].astype(float) * x[k] for k in at}
        z = machine.bias + sum(float(machine.w[k]) * x[k] for k in at) + sum(float(v[a] @ v[b]) for i, a in enumerate(at) for b in at[:i])
        assert rows[d.doc_id] == pytest.approx(sigmoid(z), abs=2e-4), d.doc_id


def bucket_of(a, b, c):
    return (((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 19) & (language.BUCKETS - 1)


def test_language_fusion(spark, sf, tables):
    names, table = language.fit_text(tables["documents"])
    n = len(names)
    parts = language.page_parts(tables["pages"]).collect()
    text_log, best = [], []
    for p in parts:
        t = lowered(p.text)
        found = [bucket_of(*g) for g in zip(t, t[1:], t[2:], strict=False)]
        scale = min(len(found), language.CERTAIN) / max(len(found), 1)
        s = [math.fsum(row[b] for b in found) * scale for row in table.tolist()]
        text_log.append(s)
        best.append(s.index(max(s)) if found else None)
    by_host, by_suffix, said, whole = (defaultdict(lambda: [0.0] * n) for _ in range(4))
    for p, b in zip(parts, best, strict=True):
        for counts in (by_host[p.suffix, p.host], by_suffix[p.suffix], said[p.declared], whole[""]):
            if b is not None:
                counts[b] += 1
    total = [c + 1 for c in whole[""]]
    corpus = [t / sum(total) for t in total]
    smooth = lambda c, prior, weight: [(a + weight * q) / (sum(c) + weight) for a, q in zip(c, prior, strict=True)]
    fit = lambda c: [(a + 1) / (t + 10) for a, t in zip(c, total, strict=True)]
    want = []
    for p, s, b in zip(parts, text_log, best, strict=True):
        prior = smooth(by_host[p.suffix, p.host], smooth(by_suffix[p.suffix], corpus, language.SUFFIX_WEIGHT), language.HOST_WEIGHT)
        told = fit(said[p.declared]) if p.declared else [1.0] * n
        score = [a + math.log(q) + math.log(d) + math.log(f) for a, q, d, f in zip(s, prior, told, fit(by_suffix[p.suffix]), strict=True)]
        top = max(score)
        want.append((p.page_id, names[score.index(top)], round(1 / sum(math.exp(v - top) for v in score), 6), None if b is None else names[b]))
    got = [(r.page_id, r.lang, round(r.probability, 6), r.text_lang) for r in language.query(spark, sf).collect()]
    assert len(got) == len(parts) == tables["pages"].count()
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and a[2] == pytest.approx(b[2], abs=2e-6)


def test_language_of_documents_that_were_not_learnt_from(spark, tables):
    """Pages without declarations, on hosts of mixed languages, so that their language is nowhere an input."""
    docs = tables["documents"].where("length(text) > 100").select("doc_id", "text", "lang")
    unseen = docs.where("doc_id % 2 = 0").collect()
    pages = [(r.doc_id, f"http://host{r.doc_id % 3}.example/", "<p>" + r.text.replace("<", " ").replace("&", " ") + "</p>") for r in unseen]
    found = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.where("doc_id % 2 = 1"))
    truth = {r.doc_id: r.lang for r in unseen}
    right = [r.lang == truth[r.page_id] for r in found.collect()]
    assert len(right) == len(pages) and sum(right) >= 0.9 * len(right)


def test_recall_on_the_table(spark, sf, tables):
    rows = [(r[0], np.array(r[1], float)) for r in tables["embeddings"].select("vec_id", *[c for c in tables["embeddings"].columns if c != "vec_id"][:1]).collect() if r[1] is not None and None not in r[1]]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, all_ = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = defaultdict(set)
    for r in neighbours.query(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hits = wanted = 0
    for i, v in rows:
        if i % 100 == 0:
            away = np.sqrt(((all_ - v) ** 2).sum(1))
            near = [int(ids[j]) for j in np.lexsort((ids, away)) if ids[j] != i][:10]
            hits, wanted = hits + len(set(near) & got[i]), wanted + len(near)
    assert wanted and hits >= 0.9 * wanted
