"""The trigram index against a scan of all values."""

import pytest

from retentia.operators import substrings as T

TEXTS = ["ring", "RINGS of Rin", "in", "", None, "éring", "grin", "spring ring", "ri ng", "ring", "aaaa", "aa", "r.ng%_", "x" * 200_000 + "ring", "a😀bc", "😀😀😀"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "id int, t string, gram int, at int").repartition(3)
    return df, T.build(df, "t", str(tmp_path_factory.mktemp("index") / "t"))


@pytest.mark.parametrize("needle", ["ring", "RIN", "in", "", "ing r", "éri", "aaa", "nothing", ".ng%", "xring", "😀b", "A😀B", "😀😀😀", "ringring"])
def test_same_rows_as_a_scan(indexed, needle):
    df, index = indexed
    got = sorted(r.id for r in T.rows_with(df, "t", index, needle).collect())
    assert got == [i for i, t in enumerate(TEXTS) if t is not None and needle.lower() in t.lower()]


def test_empty_table(spark, indexed, tmp_path):
    df = indexed[0].where("1 = 0")
    assert T.rows_with(df, "t", T.build(df, "t", str(tmp_path / "none")), "ring").count() == 0


def test_a_search_reads_its_own_trigrams(spark, indexed):
    plan = T.values_with(spark, indexed[1], "ring")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [ing,rin])" in plan


def test_no_text_is_shuffled_to_find_rows(spark, indexed):
    plan = T.rows_with(indexed[0], "t", indexed[1], "ring")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(lower(t" in plan and "low#" not in plan


def test_postings_are_lists_of_the_values_that_hold_a_trigram(spark, indexed):
    rows = spark.read.parquet(indexed[1].postings).selectExpr("gram", "explode(at) as at").collect()
    low = {r.low: r.at for r in spark.read.parquet(indexed[1].values).collect()}
    assert len(low) == len({t.lower() for t in TEXTS if t is not None})
    assert sorted((r.gram, r.at) for r in rows) == sorted((g, at) for t, at in low.items() for g in T.grams_of(t))


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_postings_of_some_texts_at_a_time(monkeypatch, most):
    import pyarrow as pa

    monkeypatch.setattr(T, "CHARACTERS", most)
    texts = ["a\0\0", "", "abcabc", "ab", "日本語日本", "abc"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(6), pa.int64())], ["low", "at"])
    got = [(g, a) for b in T.postings([batch]) for g, at in zip(*(c.to_pylist() for c in b.columns), strict=True) for a in at]
    assert sorted(got) == sorted((g, i) for i, t in enumerate(texts) for g in T.grams_of(t))


def test_postings_of_more_letters_than_a_number_holds():
    import numpy as np

    letters = "".join(map(chr, range(0x20000, 0x20000 + 30_000)))
    texts = [letters] + ["abc"] * 400_000
    got = {}
    for grams, offsets, numbers in T.postings_of(texts, np.arange(len(texts))):
        for g, i, j in zip(grams, offsets, offsets[1:], strict=False):
            got.setdefault(g, []).extend(numbers[i:j].tolist())
    assert got.pop("abc") == list(range(1, len(texts)))
    assert got == {letters[i : i + 3]: [0] for i in range(len(letters) - 2)}
