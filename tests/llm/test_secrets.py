"""Secret scans against searches of every text, and the trigram queries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from retentia.llm import secrets

#: The base rules as they are given: expression, measured group, characters.
GIVEN = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def force(text, rules=secrets.RULES):
    out = []
    for i, r in enumerate(rules):
        pattern, group, least = GIVEN.get(r.kind, (r.pattern, r.measured, r.least))
        out += [(m.start(), i, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m.group(group)) >= least]
    return sorted(out)


TEXTS = [
    "token=token: abcdefgh",
    "🦆 password = 'hunter2x' AKIA" + "B" * 16 + " é " + "0a" * 12 + "0a" * 30,
    'PassWD:"abcdef" api_key=abc apikey:  abcdefg',
    "AKIAAKIA" + "X" * 13 + " " + "f" * 24 + " " + "f" * 23 + "AKIA" + "Y" * 15,
    None,
    "",
    "x",
    "secret:x=yyyyyyy password==zzzzzz api_key'='" + "é" * 9,
    " ".join(["token=abcdefgh"] * 2500),  # more spans than a list takes at once
    "ghp_" + "a1" * 18 + " AIza" + "b" * 35 + "AIza",
    "-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN PRIVATE KEY-----",
    "xoxb-1234567890ab eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9,
    "ſecret=abcdefgh toKen=abcdefgh toKen=abcdefgh",
]


def test_odd_texts(spark):
    rng = random.Random(12)
    parts = ["token", "SECRET", "api_key", "passwd", "password", "=", ":", " ", "'", '"', "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "🦆", "\n", "-", "gh"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kinds string, k int").repartition(3)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(docs).collect()}
    assert got == {i: force(t) for i, t in enumerate(texts)}


def test_repeated_rows_and_shared_ids(spark):
    rows = [(1, "token=abcdefgh"), (1, "token=abcdefgh"), (1, "nothing"), (None, "token=abcdefgh"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in secrets.scan(docs).collect())
    assert got == sorted((str(i), force(t)) for i, t in rows)
    assert secrets.scan(docs.where("false")).count() == 0


def test_many_candidates_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    monkeypatch.setattr(secrets.C, "BROADCAST_IDS", 0)
    found = secrets.scan(docs)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()} == {i: force(t) for i, t in enumerate(TEXTS)}


def test_rules_without_trigrams_and_other_rules(spark):
    rules = (secrets.Rule("digits", r"[0-9]{4}"), secrets.Rule("either", r"(?:foo|barbaz)+x"), secrets.Rule("part", r"ab(cd)?ef"))
    docs = spark.createDataFrame([(1, "1234567890 foox barbazfoox"), (2, "abef abcdef"), (3, "foo")], "doc_id long, text string")
    for some in (rules, rules[:1]):
        assert {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(docs, some).collect()} == {r.doc_id: force(r.text, some) for r in docs.collect()}


@pytest.mark.parametrize(
    "pattern, wanted",
    [
        ("abcd", [{frozenset({"abc", "bcd"})}]),
        ("AbC", [{frozenset({"abc"})}]),
        ("[0-9]+", []),
        ("ab", []),
        ("abc|de", []),
        ("(?:abc|bcd)x*", [{frozenset({"abc"}), frozenset({"bcd"})}]),
        ("abc.*xyz", [{frozenset({"abc"})}, {frozenset({"xyz"})}]),
        ("a(?:bc)?d", []),
        ("(?:abc)?xyz", [{frozenset({"xyz"})}]),
        ("(?:abc)*", []),
        ("(?:abc)+", [{frozenset({"abc"})}]),
        ("a{3}", [{frozenset({"aaa"})}]),
        ("^abc$", [{frozenset({"abc"})}]),
    ],
)
def test_trigram_queries(pattern, wanted):
    assert [set(d) for d in secrets.trigram_query(pattern)] == wanted


def test_every_match_meets_its_query():
    """On texts that hold matches: no query asks for what a match lacks."""
    for r in secrets.RULES:
        for t in TEXTS:
            if t and re.search(r.pattern, t):
                low = t.lower()
                assert all(any(all(g in low for g in option) for option in d) for d in secrets.trigram_query(r.pattern))


def test_the_plan_has_no_python(spark, sf):
    plan = secrets.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    postings = secrets.index(spark.createDataFrame([(1, 2, "the token and the secret")], "k long, tag long, text string"), secrets.wanted_trigrams(secrets.RULES))
    held = {secrets.wanted_trigrams(secrets.RULES)[r.trigram] for r in postings.collect()}
    assert held == {t for t in secrets.wanted_trigrams(secrets.RULES) if t in "the token and the secret"}
    assert postings.groupBy("trigram").agg(F.count("*").alias("n")).where("n > 1").count() == 0
