"""Toxicity, quality, language: held-out accuracy, and rows that hold nothing."""

import random

import pytest
from pyspark.sql import functions as F

from retentia.llm import language, quality, toxicity
from retentia.llm.linear import logistic, sigmoid


def labelled(spark, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        toxic, junk = int(i % 5 == 0), int(i % 7 == 0)
        w = ["spam!!"] * 40 if junk else [f"w{rng.randrange(300)}" for _ in range(40)]
        if toxic:
            w[rng.randrange(40)] = rng.choice(["vileone", "viletwo", "vilethree"])
        docs.append((i, " ".join(w), len(w)))
        labels.append((i, 1 - junk, toxic))
    docs += [(n, None, None), (n + 1, "", 0), (None, " ".join(f"w{i}" for i in range(30)) + " vilefour", 31), (n + 2, "w " * 30_000, 60_000)]
    labels += [(None, 1, 1), (5, None, 0), (7, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in toxicity.toxicity(docs.withColumn("p_toxic", F.lit(1)), labels).collect()}
    assert len(rows) == docs.count()
    right = sum(rows[i].toxic == (i % 5 == 0) for i in range(400) if i != 7)
    assert right >= 395
    assert not rows[400].toxic and not rows[401].toxic
    # a word that no label showed tells by its beginning
    assert rows[None].p_toxic > max(rows[i].p_toxic for i in range(400) if i % 5 and i != 7)
    left = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert {400, 401, 402} <= left and 5 not in left


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert toxicity.toxicity(docs, labels.where("1 = 0")).where("toxic").count() == 0
    assert toxicity.toxicity(docs.where("1 = 0"), labels).count() == 0


def test_quality(spark, sf):
    rows = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_quality_of_nothing(spark):
    docs, labels = labelled(spark, 60)
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.quality(docs.where("1 = 0"), labels).count() == 0


def test_quality_never_reads_held_out_labels(spark):
    docs, labels = labelled(spark, 120)
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_interactions_take_linear_time():
    import numpy as np

    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.3, rng.standard_normal(6), rng.standard_normal((6, 3)))
    x = rng.standard_normal((4, 6))
    slow = [0.3 + r @ m.w + sum(m.v[i] @ m.v[j] * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert m.raw(x) == pytest.approx(slow)


def test_logistic():
    import numpy as np

    x = np.array([[0.0], [1.0]] * 50)
    w = logistic(x, x[:, 0], steps=400)
    assert sigmoid(w[0] + w[1]) > 0.9 > 0.1 > sigmoid(w[1])


def test_host_decides_where_the_text_does_not(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = {lang: docs.where(f"lang = '{lang}' and length(text) > 400").first().text.replace("<", " ") for lang in ("de", "fr")}
    pages = [(100 * n + i, f"http://{lang}-site.example/{i}", f"<p>{told[lang]}</p>") for n, lang in enumerate(told) for i in range(20)]
    pages += [(1000, "http://de-site.example/x", "<p>7</p>"), (1001, "http://fr-site.example/x", "<p>7</p>")]
    rows = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert rows[1000].text_lang == rows[1001].text_lang
    assert (rows[1000].lang, rows[1001].lang) == ("de", "fr")


def test_labels_that_disagree_have_a_defined_result(spark):
    docs, labels = labelled(spark, 120)
    more = labels.union(labels.where("doc_id < 60").selectExpr("doc_id", "1 - quality", "1 - toxic"))
    a, b = ({r.doc_id: r.score for r in quality.quality(docs, x).collect()} for x in (more, more.repartition(7, "toxic")))
    assert a == b


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = language.identify(pages, docs).collect()
    assert len(rows) == pages.count()
    assert sum(r.lang == r.declared for r in rows) >= 0.95 * len(rows)
    odd = [(1, None, None), (None, "http://a.example.org/x", ""), (2, "nonsense", "<html lang='zz'>der die und ist nicht der die das</html>"), (3, "http://h.de/", "<p>" + "le la les des une est dans pour " * 500)]
    odd += [(3, "http://h.de/", "<p>x")]
    found = language.identify(spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("prior", F.lit(1)), docs).collect()
    assert len(found) == 5 and all(r.lang in {"en", "fr", "de", "es"} and 0 < r.probability <= 1 for r in found)
    assert next(r for r in found if r.page_id == 1).text_lang is None
    assert language.identify(pages.where("1 = 0"), docs).count() == 0
    assert {r.lang for r in language.identify(pages.limit(3), docs.where("1 = 0")).collect()} == {None}


def test_logistic_of_nothing():
    import numpy as np

    assert logistic(np.zeros((0, 3)), np.zeros(0)).tolist() == [0.0] * 4


def test_toxicity_with_a_single_label(spark):
    docs, labels = labelled(spark, 20)
    rows = toxicity.toxicity(docs, labels.where("doc_id = 3")).collect()
    assert len(rows) == docs.count() and not any(r.toxic for r in rows)
