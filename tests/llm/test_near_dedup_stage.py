"""The pipeline's near-dup stage against all pairs of a small corpus, on shingles of five words."""

import random
from itertools import combinations

import corpus_pipeline


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))


def kept(docs):
    """The least id of each component of documents with a Jaccard similarity of 0.8 at least."""
    sets = {k: shingles(t) for k, t in docs}
    comp = {k: k for k in sets}
    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {k: lo if c == hi else c for k, c in comp.items()}
    return {k for k, c in comp.items() if k == c}


def test_stage_compares_five_words(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(100)]
    docs = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, "one two"), (3, "one two"), (4, "one two three")]
    for k, changed in enumerate(([50], [98], [30, 70], [9, 29, 49, 69, 89], [10, 30, 50, 70, 90]), 10):  # 5 scattered words: 0.82 on word pairs
        docs.append((k, " ".join(f"x{k}" if i in changed else w for i, w in enumerate(base))))
    docs += [(20 + k, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for k in range(5)]
    got = corpus_pipeline.keep_one_near_duplicate(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == kept(docs)
    assert {13, 14} <= kept(docs) and not {1, 3, 10, 11} & kept(docs)


def rows_kept(rows):
    """Of each component of sets of shingles the row of least id and its exact repeats; ids link nothing."""
    least = -(2**63)
    sets = {}
    for k, t in rows:
        if (t or "").split():
            sets.setdefault(shingles(t), []).append((least if k is None else k, t))
    comp = {s: i for i, s in enumerate(sets)}
    for a, b in combinations(sets, 2):
        if 100 * len(a & b) >= 80 * len(a | b) and comp[a] != comp[b]:
            old, new = comp[a], comp[b]
            comp = {s: new if c == old else c for s, c in comp.items()}
    groups = {}
    for s, c in comp.items():
        groups.setdefault(c, []).extend(sets[s])
    return groups


def test_a_near_copy_takes_no_other_text_of_its_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (2, a + " and more"), (2, b), (3, c)], "doc_id long, text string")
    got = corpus_pipeline.keep_one_near_duplicate(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, a), (2, b), (3, c)]


def test_shared_ids_by_row(spark):
    """Random rows of few ids: exactly one row (with its repeats) of each component stays, of the component's least id."""
    rng = random.Random(21)
    stems = [[f"{s}{rng.randrange(300)}" for _ in range(60)] for s in "pqrstu"]
    rows = [(9, None), (9, " "), (None, None)]
    for _ in range(90):
        words = rng.choice(stems).copy()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((rng.choice([None, *range(12)]), " ".join(words)))
    rows += rows[10:20]
    got = corpus_pipeline.keep_one_near_duplicate(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    kept_rows = [(r.doc_id, r.text) for r in got.collect()]
    groups = rows_kept(rows)
    assert sorted(map(str, (r for r in kept_rows if not (r[1] or "").split()))) == sorted(map(str, rows[:3]))
    kept_rows = [(-(2**63) if k is None else k, t) for k, t in kept_rows if (t or "").split()]
    for members in groups.values():
        mine = [r for r in kept_rows if r in members]
        assert len(set(mine)) == 1 and mine[0][0] == min(k for k, _ in members) and len(mine) == members.count(mine[0])
    assert len(kept_rows) == sum(sum(r in g for r in kept_rows) for g in groups.values())
