"""Secret scans by a trigram index.

From each rule's regular expression follows a Boolean query over trigrams that every match must hold. The index lists, for
each trigram that the queries name, the rows whose text holds it (in lower case). Postings are intersected row by row; only
rows that a rule's query leaves are searched with its expression. Rules without mandatory trigrams search every row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

Disjunction = frozenset[frozenset[str]]
#: Strings that a part of an expression may stand for before its trigrams are taken and it counts as anything.
STRINGS = 128
#: Trigrams whose presence one long holds.
BITS = 60
#: Spans that are added to a list one by one before the list is put aside.
FOLDED = 500


@dataclass(frozen=True)
class Rule:
    """kind: name in spans; pattern: an expression that Java and Python read alike; measured and least: the group that must
    have so many characters, else the match is dropped (its text stays consumed)."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1


#: The first three rules are given, the others are public formats of keys. Where the given length is one of a
#: run of one class, the run is asked for at that length: a shorter run holds no match, and a longer one the same.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE_RULES,
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def any_of(strings: set[str]) -> Disjunction | None:
    """Trigrams of one of the strings; None if some string has none. Alternatives that ask for more than another go."""
    options = {trigrams(s) for s in strings}
    if frozenset() in options:
        return None
    return frozenset(o for o in options if not any(other < o for other in options))


def trigram_query(pattern: str) -> list[Disjunction]:
    """What a text (in lower case) must hold for the pattern to match: of each disjunction all trigrams of one alternative.
    An empty list: nothing is mandatory."""
    tree = re._parser.parse(pattern)

    def walk(items) -> tuple[set[str] | None, list[Disjunction]]:
        """(all strings that the items stand for, if few; else None and what they demand)."""
        strings, demands, exact = {""}, [], True

        def flush():
            nonlocal strings, exact
            wanted = any_of(strings)
            demands.extend([wanted] if wanted else [])
            strings, exact = {""}, False

        for op, value in items:
            options, inner = expand(str(op), value)
            demands.extend(inner)
            if options is not None and len(strings) * len(options) <= STRINGS:
                strings = {s + o for s, o in product(strings, options)}
            else:
                flush()
                if options is not None and len(options) <= STRINGS:
                    strings = set(options)
        if exact:
            return strings, []
        flush()
        return None, demands

    def expand(op: str, value) -> tuple[set[str] | None, list[Disjunction]]:
        if op == "LITERAL":
            return {chr(value).lower()}, []
        if op == "IN":
            found: set[str] = set()
            for kind, v in value:
                if str(kind) == "LITERAL":
                    found.add(chr(v).lower())
                elif str(kind) == "RANGE" and v[1] - v[0] < STRINGS:
                    found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    return None, []
            return found, []
        if op == "SUBPATTERN":
            return walk(value[3])
        if op == "BRANCH":
            branches = [walk(b) for b in value[1]]
            if all(s is not None for s, _ in branches):
                union = set().union(*(s for s, _ in branches))
                return (union, []) if len(union) <= STRINGS else (None, [w for w in [any_of(union)] if w])
            return None, []
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = value
            strings, demands = walk(body)
            if strings is not None and int(most) == 1:
                return strings | ({""} if least == 0 else set()), []
            if least == 0:
                return None, []
            if strings is not None and int(most) == int(least) and len(strings) ** least <= STRINGS:
                return {"".join(p) for p in product(strings, repeat=least)}, []
            return None, demands if strings is None else [w for w in [any_of(strings)] if w]
        return ({""}, []) if op == "AT" else (None, [])

    strings, demands = walk(tree)
    if strings is not None:
        wanted = any_of(strings)
        return [wanted] if wanted else []
    return demands


def wanted_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams of all rules' queries, in order; a trigram's place is its number in the index."""
    return sorted({t for r in rules for d in trigram_query(r.pattern) for option in d for t in option})


def index(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings: trigram (number), k and tag of the rows whose text holds it in lower case, sorted by trigram within files.
    rows: k, tag, text."""
    low = rows.select("k", "tag", F.lower("text").alias("low"))
    low = low.select("k", "tag", F.array(*(F.contains(F.col("low"), F.lit(t)) for t in wanted)).alias("held"))
    # outer: Spark guards a plain explode by a filter on its array, which would look for all trigrams again
    return C.written(low.select(F.posexplode_outer("held").alias("trigram", "held"), "k", "tag").where("held").drop("held").sortWithinPartitions("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...], wanted: list[str]) -> DataFrame:
    """k, tag and kinds (those rules with trigrams whose queries the row meets), for rows with any. Postings of a row are
    combined before they are shuffled."""
    number = {t: i for i, t in enumerate(wanted)}
    words = range(-(-len(wanted) // BITS))
    bit = lambda w: F.when(F.floor(F.col("trigram") / BITS) == w, F.expr(f"shiftleft(1L, trigram % {BITS})")).otherwise(F.lit(0).cast("long"))
    masks = postings.groupBy("k", "tag").agg(*(F.bit_or(bit(w)).alias(f"m{w}") for w in words))

    def holds(option: frozenset[str]) -> Column:
        parts = []
        for w in words:
            mask = sum(1 << number[t] % BITS for t in option if number[t] // BITS == w)
            parts += [F.col(f"m{w}").bitwiseAND(F.lit(mask)) == mask] if mask else []
        return all_(parts)

    met = [F.when(all_([any_(list(map(holds, sorted(d, key=sorted)))) for d in query]), F.lit(r.kind)) for r in rules if (query := trigram_query(r.pattern))]
    return masks.select("k", "tag", F.array_compact(F.array(*met)).alias("kinds")).where(F.size("kinds") > 0)


def all_(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def any_(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, kind's order, end; code points) of a rule's matches in a text, by start: what stands between matches and
    the matches are measured in turn. Lists are folded in parts, so that long ones aren't copied for each span."""
    pattern = F.lit(rule.pattern)
    pieces = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"), F.regexp_extract_all(text, pattern, F.lit(rule.measured)).alias("part"))
    spans = "array<struct<start:int,kind:int,end:int>>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("open"), F.array().cast(f"array<{spans}>").alias("done"))

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["match"]), F.lit(0))  # after the last match only a gap is left
        here = F.when(F.char_length(x["part"]) >= rule.least, F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))).otherwise(F.array().cast(spans))
        full = F.size(s["open"]) >= FOLDED
        return F.struct(
            end.alias("at"),
            F.concat(F.when(full, F.array().cast(spans)).otherwise(s["open"]), here).alias("open"),
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
        )

    return F.aggregate(pieces, state, add, lambda s: F.concat(F.flatten(s["done"]), s["open"]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of start, kind (place in rules), end in code points, end exclusive; by start, then kind) of
    every row.

    docs: doc_id, text; others ignored. Matches are leftmost and don't overlap within a rule; matches whose measured group is
    too short are dropped. Null and empty text: no spans. Null ids and repeated rows: rows like others. No documents: no
    rows. Rules name their kinds once each. A rule without mandatory trigrams searches every text.

    Candidates are written and counted: few are broadcast, and then texts needn't be shuffled; many are joined.
    """
    k, tag = C.row_key(docs)
    wanted = wanted_trigrams(rules)
    none = F.array().cast("array<string>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k.alias("k"), tag.alias("tag"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    if wanted:
        found = C.written(candidates(index(rows, wanted), rules, wanted))
        found = F.broadcast(found) if found.count() <= C.BROADCAST_IDS else found
        rows = rows.join(found, ["k", "tag"], "left").withColumn("kinds", F.coalesce("kinds", none))
    else:
        rows = rows.withColumn("kinds", none)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for i, r in enumerate(rules):
        spans = spans_of(F.col("text"), r, i)
        parts.append(F.when(F.array_contains("kinds", r.kind), spans).otherwise(empty) if trigram_query(r.pattern) else spans)
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *(of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)),
        F.sha2(joined(base, RULES), 256).alias("base_sha256"),
        joined(F.col("spans"), RULES).alias("spans"),
    )
