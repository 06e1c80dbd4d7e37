"""Shards, packing, decontamination and neighbours."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import decontamination, neighbours, packing, sharding


def test_shards(documents, no_documents, corpus):
    rows = sharding.shards(documents, 6).collect()
    assert len(rows) == len(corpus)
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in corpus)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
    # contiguous in order of ids, and off the target by one document at most
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    total, biggest = sum(r.size for r in rows), max(r.size for r in rows)
    assert all(abs(sum(r.size for r in shard) - total / 6) <= biggest for shard in by.values())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert sharding.shards(no_documents).count() == 0


def test_shards_of_the_table_in_sql(spark, sf):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql("""WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size FROM documents),
      p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS everything, row_number() OVER (ORDER BY doc_id) AS place FROM d),
      s AS (SELECT *, CAST(least(23, ((2 * upto - size) * 24) // (2 * everything)) AS INTEGER) AS shard FROM p)
      SELECT doc_id, shard, place - min(place) OVER (PARTITION BY shard) AS slot FROM s ORDER BY doc_id""").fetchall()
    got = sharding.query(spark, sf).orderBy("doc_id").select("doc_id", "shard", "slot").collect()
    assert [tuple(r) for r in got] == want


def test_cuts_minimise_padding_and_penalties():
    """Against a search over all ways to cut."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        at = np.unique(rng.integers(1, 40, 9))
        total = int(at[-1])
        penalty = rng.choice([0, 3, 7], len(at))
        penalty[-1] = 0
        if (np.diff(np.append(0, at)) > 12).any():
            continue
        cost = dict(zip(at.tolist(), penalty.tolist(), strict=True))

        def price(ends):
            return sum(12 - (b - a) + cost[b] for a, b in zip([0, *ends], ends, strict=False))

        best = {0: 0}
        for e in at.tolist():
            best[e] = min(best[s] + 12 - (e - s) + cost[e] for s in best if e - s <= 12)
        got = packing.plan_cuts(total, at, penalty, 12)
        assert got[-1] == total and all(b - a <= 12 for a, b in zip([0, *got], got, strict=False))
        assert price(got) == best[total]


def test_cut_inside_what_no_window_holds():
    assert packing.plan_cuts(100, np.array([5, 100]), np.array([0, 0]), 30)[-1] == 100


def test_packing(documents, no_documents, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(documents, packing.default_tokenizer(), 256).collect()
    ids = defaultdict(list)
    for d, t in corpus:
        ids[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    pieces = defaultdict(int)
    for r in rows:
        assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[r.doc_id])
        pieces[r.doc_id] += r.length
    assert {d: sum(map(len, x)) for d, x in ids.items()} == pieces
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    for w in windows.values():
        end = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 256
    assert sorted(windows) == list(range(len(windows)))
    assert packing.pack(no_documents, packing.default_tokenizer()).count() == 0


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    from retentia.llm import common as C
    import pyarrow as pa

    texts = ["It's, we'll... ok?! (yes)", "É́te NAÏVE ﬁ ǅ İ", "Ÿ ÿœuf straße STRASSE Ærø æ µ ª º ß ẞ mañana÷ación ×", "a b c 12,345.6;", "x<|endoftext|>y <|EndOfText|>", "", "Word, WORD, word,", "…, 'tis ’s d'accord"]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    data, off = C.text_buffer(pa.array(texts))
    words = packing.WordIds(packing.default_tokenizer())
    ids, toff, _ = packing.tokens(data, off, words)
    for i, t in enumerate(texts):
        assert ids[toff[i] : toff[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


ITEM = "The quick brown fox jumps over the lazy dog. Then a slow green turtle walks under seven old bridges near town."


def test_leaks(spark):
    a, b = ITEM.split(". ")
    docs = [(1, f"noise words here {ITEM} more noise"), (2, f"{b} some words between {a.upper()}!!"), (3, a), (4, "nothing of it at all"), (5, None), (6, ""), (None, ITEM), (7, ITEM), (7, ITEM), (8, "tiny one"), (9, ("filler " * 20_000) + ITEM)]
    items = [(10, ITEM), (11, "tiny one"), (12, None), (13, "..."), (14, "unrelated text that no document has in any of its lines")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(3)).withColumn("seed", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.leaks(df, bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in rows) == sorted([(False, 1, 10), (False, 2, 10), (True, 0, 10), (False, 7, 10), (False, 7, 10), (False, 8, 11), (False, 9, 10)])
    turned = next(r for r in rows if r.doc_id == 2)
    assert turned.n_tiles == 2 and turned.coverage == 1.0
    assert decontamination.leaks(df.where("1 = 0"), bench).count() == 0 and decontamination.leaks(df, bench.where("1 = 0")).count() == 0
    left = decontamination.drop_leaking(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6}


def test_leaks_in_several_passes(spark, monkeypatch):
    df, bench = spark.createDataFrame([(1, ITEM), (2, "other " + ITEM)], "doc_id long, text string"), spark.createDataFrame([(i, f"{ITEM} {i}") for i in range(20)], "item_id long, text string")
    once = sorted(map(tuple, decontamination.leaks(df, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, decontamination.leaks(df, bench).collect())) == once and len(once) == 40


def test_tiles_are_the_longest_first():
    x = np.arange(1, 40, dtype=np.uint64)
    doc = np.concatenate([x[20:39], np.array([99], np.uint64), x[:20]])
    assert sorted(t[2] for t in decontamination.greedy_tiles(x, doc, 5)) == [19, 20]


def neighbours_by_force(rows, k, every):
    live = {}
    for i, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or [])):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8 and i not in live:
            live[i] = np.array(v)
    out = []
    for q in live:
        if q % every == 0:
            d = sorted((float(np.sqrt(((live[q] - live[c]) ** 2).sum())), c) for c in live if c != q)[:k]
            out += [(q, n, c, s) for n, (s, c) in enumerate(d, 1)]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 60)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)] + [(300 + i, [1.0] * 8) for i in range(150)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("inf")] * 8), (905, [1.0] * 3), (None, [1.0] * 8), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, 10, 20).collect())
    want = sorted(neighbours_by_force(rows, 10, 20))
    assert {(q, n) for q, n, _, _ in got} == {(q, n) for q, n, _, _ in want}
    same = len({(q, c) for q, _, c, _ in got} & {(q, c) for q, _, c, _ in want})
    assert same >= 0.9 * len(want)
    exact = {(q, c): s for q, _, c, s in want}
    assert all(s == pytest.approx(exact[q, c], rel=1e-12) for q, _, c, s in got if (q, c) in exact)
    assert neighbours.nearest(df.where("1 = 0")).count() == 0
    few = neighbours.nearest(df.where("vec_id in (20, 21, 22)"), 10, 20).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(20, 1), (20, 2)]
