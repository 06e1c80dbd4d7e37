import random

import pytest


def words(rng, n, stem="w"):
    return [f"{stem}{rng.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, a common line, repeats inside a document, nulls, blanks, a
    repeated row, one id with two texts, a null id, a long text, text beyond ASCII."""
    rng = random.Random(5)
    base = words(rng, 120)
    line = " ".join(words(rng, 40, "line"))
    docs = [(i, " ".join(words(rng, rng.randrange(1, 90)))) for i in range(40)]
    docs += [(100 + i, " ".join(base)) for i in range(6)]  # copies
    for i in range(8):  # near copies
        own = base.copy()
        own[rng.randrange(120)] = f"x{i}"
        docs.append((200 + i, " ".join(own)))
    docs += [(300 + i, " ".join(words(rng, 20)) + " " + line + "\n" + " ".join(words(rng, 20))) for i in range(12)]
    docs += [(400, " ".join(base[:50] * 3)), (401, "é" * 150 + " ßü " + "é" * 150), (402, "a" * 130), (403, "Upper UPPER upper"), (404, "upper upper Upper")]
    docs += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "one"), (505, " one two")]
    docs += [(600, " ".join(base[:90])), (600, " ".join(base[:90])), (601, " ".join(base[10:100])), (601, " ".join(words(rng, 60)))]
    docs += [(None, " ".join(base[5:80])), (700, " ".join(words(rng, 9000)))]
    return docs


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns that operators use inside, too."""
    rows = [(d, t, "en", "src", len(t or ""), 1, "k", 2, None) for d, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k int, tag string, part int, spans int").repartition(5)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("1 = 0")
