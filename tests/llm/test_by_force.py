"""Benchmark decontamination and the pipeline's stages against plain versions, odd rows included."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_near_dedup_stage import shingles
from test_windows import LEAST

import corpus_pipeline
from retentia.llm import decontamination, packing


def words(text):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())


def tiles(item, doc, least):
    """Longest common stretches of free words, again and again; of equal ones the first in the item, then in the document."""
    free_item, free_doc, out = [True] * len(item), [True] * len(doc), []
    while True:
        best, run = (0, 0, 0), [0] * (len(doc) + 1)
        for i in reversed(range(len(item))):
            new = [0] * (len(doc) + 1)
            for j in range(len(doc)):
                if free_item[i] and free_doc[j] and item[i] == doc[j]:
                    new[j] = run[j + 1] + 1
            run = new
            best = min([best, *((-n, i, j) for j, n in enumerate(run) if n)])
        size, i, j = best
        if -size < least or not size:
            return out
        out.append((i, j, -size))
        free_item[i : i - size] = [False] * -size
        free_doc[j : j - size] = [False] * -size


def leaks(docs, items, least=5, coverage=0.8):
    out, seeds = [], defaultdict(set)
    own = {n: words(t) for n, (_, t) in enumerate(items)}
    width = {n: min(least, len(w)) for n, w in own.items()}
    for n, w in own.items():
        for s in range(len(w) - width[n] + 1 if w else 0):
            seeds[tuple(w[s : s + width[n]])].add(n)
    for d, t in docs:
        w = words(t)
        met = {n for k in set(width.values()) - {0} for s in range(len(w) - k + 1) for n in seeds.get(tuple(w[s : s + k]), ())}
        for n in met:
            found = tiles(own[n], w, width[n])
            covered = sum(x[2] for x in found)
            if covered >= coverage * len(own[n]):
                out.append((d, items[n][0], len(own[n]), covered, len(found), max(x[2] for x in found), round(covered / len(own[n]), 9)))
    return Counter(out)


def of(rows):
    return Counter((r.doc_id, r.item_id, r.item_words, r.covered_words, r.n_tiles, r.longest_tile, round(r.coverage, 9)) for r in rows)


def test_leaks_of_the_whole_tables(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = leaks([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert of(decontamination.query(spark, sf).collect()) == want and want


def test_leaks_in_texts_of_few_words(spark):
    import random

    rng = random.Random(4)
    text = lambda most: " ".join(rng.choice("abc") for _ in range(rng.randrange(most)))
    docs, items = [(i, text(60)) for i in range(60)], [(i, text(16)) for i in range(12)]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = leaks(docs, items)
    assert of(got.collect()) == want and len(want) > 100


def passages_gone(corpus, width=100):
    """(doc_id, text) of what cutting repeated bytes leaves, characters whole."""
    first, order = {}, [(LEAST if d is None else d, (t or "").encode()) for d, t in corpus]
    for k, raw in order:
        for s in range(len(raw) - width + 1):
            first[raw[s : s + width]] = min(first.get(raw[s : s + width], (k, s)), (k, s))
    out = []
    for (d, t), (k, raw) in zip(corpus, order, strict=True):
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            if first[raw[s : s + width]] < (k, s):
                gone[s : s + width] = b"\1" * width
        at, kept = 0, []
        for c in t or "":
            size = len(c.encode())
            if not any(gone[at : at + size]):
                kept.append(c)
            at += size
        if not any(gone) or "".join(kept).strip(" "):
            out.append((d, "".join(kept)))
    return Counter(out)


def one_of_each(corpus):
    """Rows that stay: of linked rows those of the least id."""
    ids = [LEAST if d is None else d for d, _ in corpus]
    sets = [shingles(t) if (t or "").split() else frozenset() for _, t in corpus]
    comp = list(range(len(corpus)))
    for a in range(len(corpus)):
        for b in range(a):
            if sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    least = {c: min(i for i, x in zip(ids, comp, strict=True) if x == c) for c in set(comp)}
    return Counter(row for row, i, c in zip(corpus, ids, comp, strict=True) if i == least[c])


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    """A folder with the labels and the benchmark of the small corpus."""
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = dict(corpus)
    items = [(1, texts[300]), (2, " ".join(texts[400].split()[:30])), (3, None), (4, ""), (5, "one"), (6, "nowhere at all in these texts here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (None, 1, 1), (1, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, items


def held(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_by_force(spark, corpus, documents, tables):
    stages, (folder, items) = dict(corpus_pipeline.STAGES), tables
    assert held(stages["toxicity"](spark, documents, folder)) == Counter(corpus)
    assert held(stages["minhash_near_dedup"](spark, documents, folder)) == one_of_each(corpus)
    cut = stages["suffix_array_dedup"](spark, documents, folder)
    assert held(cut) == passages_gone(corpus)
    assert cut.columns == documents.columns and cut.where("n_chars <> length(text)").count() == 0
    leaking = {row for row in corpus if leaks([row], items)}
    assert held(stages["decontamination"](spark, documents, folder)) == Counter(r for r in corpus if r not in leaking) and leaking


def test_packed_ids_are_the_texts(spark, corpus, documents, tables):
    from tokenizers import Tokenizer

    rows = dict(corpus_pipeline.STAGES)["packing"](spark, documents, tables[0]).collect()
    model = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    ids = [(d, [*model.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in corpus]
    for d, x in ids:
        want[d] += len(x)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
        near = [x for d, x in ids if d == r.doc_id and len(x) == r.doc_tokens]
        assert any(zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) == r.ids_crc32 for x in near)
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        ends = [0]
        for at, size in sorted(pieces):
            assert at == ends[-1]
            ends.append(at + size)
        assert ends[-1] <= 4096


def test_stages_of_nothing(spark, no_documents, tables):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_documents.withColumn("more", F.lit("x")), tables[0])
        assert out.count() == 0, name
        assert name == "packing" or out.columns == [*no_documents.columns, "more"], name
