"""SQL that gives the rows of corpus queries where SQL can express them."""

from __future__ import annotations

import re

#: Bytes of a text as a list of two hexadecimal digits each; CRC-32 over them by its polynomial, bit by bit.
_BYTES = "regexp_extract_all(hex(coalesce(text, '')), '..')"
_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"

SHARDS = f"""WITH tab AS MATERIALIZED (SELECT {_TABLE} AS t),
  d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_transform({_BYTES}, lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM documents, tab),
  p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS everything, row_number() OVER (ORDER BY doc_id) AS place FROM d),
  s AS (SELECT *, CAST(least(23, ((2 * upto - size) * 24) // (2 * everything)) AS INTEGER) AS shard FROM p)
  SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

#: Windows of 100 bytes (200 hexadecimal digits) that also start earlier; what they cover goes.
REPEATED_BYTES = """WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
  w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS m FROM (SELECT *, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
  f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS place FROM w),
  r AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM f WHERE place > 1),
  g AS (SELECT doc_id, s, count_if(gap IS NULL OR gap > 100) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM r),
  c AS (SELECT doc_id, span, min(s) AS lo, max(s) + 100 AS hi FROM g GROUP BY 1, 2),
  e AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS removed, count(*) AS spans FROM c GROUP BY 1),
  k AS (SELECT d.doc_id, n, coalesce(removed, 0) AS removed, coalesce(spans, 0) AS spans,
    CASE WHEN los IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(los) + 2), lambda i: substr(h, 2 * CASE WHEN i = 1 THEN 0 ELSE his[i - 1] END + 1, 2 * (CASE WHEN i > len(los) THEN n ELSE los[i] END - CASE WHEN i = 1 THEN 0 ELSE his[i - 1] END))), '') END AS kept
    FROM d LEFT JOIN e USING (doc_id))
  SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k"""

#: Windows of 35 words that stand more than once.
REPEATED_WORDS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  p AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS m FROM (SELECT *, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
  r AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY m) AS times FROM p) WHERE times > 1),
  b AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 35)))) AS gone FROM r GROUP BY 1),
  x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
  y AS (SELECT doc_id, unnest(gone) AS i FROM b),
  k AS (SELECT x.doc_id, count(*) AS removed_not, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN y USING (doc_id, i) GROUP BY 1)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(removed_not, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

#: Sets of two-word shingles, links at 100 * intersection >= 80 * union, and components by least reachable id.
NEAR_DUPLICATES = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
  u AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
  i AS (SELECT a.doc_id AS p, b.doc_id AS q, any_value(a.n) AS np, any_value(b.n) AS nq, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY 1, 2),
  l AS MATERIALIZED (SELECT p, q FROM i WHERE 100 * shared >= 80 * (np + nq - shared)),
  e AS MATERIALIZED (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
  reach AS (SELECT p AS doc_id, q AS other FROM e UNION SELECT r.doc_id, e.q FROM reach r JOIN e ON e.p = r.other),
  c AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM reach GROUP BY 1)
  SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c USING (doc_id)"""


def secret_spans(rules: tuple, base: int) -> str:
    """Spans of each rule's matches from the lengths of what stands between matches and of the matches."""
    either = lambda m: "(" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m.group(1)) + ")"
    patterns = [re.sub(r"\(\(\?i:([^()]*)\)\)", either, r.pattern).replace("'", "''") for r in rules]
    pieces = ", ".join(f"string_split_regex(t, '{p}') AS g{i}, regexp_extract_all(t, '{p}') AS m{i}, regexp_extract_all(t, '{p}', {r.measured}) AS q{i}" for i, (r, p) in enumerate(zip(rules, patterns, strict=True)))
    length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    spans = ", ".join(
        f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda k: length(q{i}[k]) >= {r.least}), lambda k: {{'s': CAST({length(f'g{i}[1:k]')} + {length(f'm{i}[1:k-1]')} AS BIGINT), 'k': {i}, 'e': CAST({length(f'g{i}[1:k]')} + {length(f'm{i}[1:k]')} AS BIGINT)}})"
        for i, r in enumerate(rules)
    )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    text = lambda x: f"array_to_string(list_transform({x}, lambda x: {kinds}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"CAST(len(list_filter(z, lambda x: x.k = {i})) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(rules[:base]))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, {pieces} FROM d),
  s AS (SELECT doc_id, list_sort(flatten([{spans}])) AS z FROM p)
  SELECT doc_id, {counts}, sha256({text(f"list_filter(z, lambda x: x.k < {base})")}) AS base_sha256, {text("z")} AS spans FROM s"""
