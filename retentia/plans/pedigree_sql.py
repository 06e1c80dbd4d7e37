"""The pedigree in SQL: node traces, their peaks, and each tier's agreement, with list functions and unrolled tiers."""

from __future__ import annotations

import re

from .q_traces import clipped_sql, normal_tail_sql, peaks_sql

WINDOW = 2.3548200450309493

#: Traces of nodes: counts with a signal laid over them. Some blocks have none, some come before their parents.
SIGNAL = """ns AS (SELECT compound_id, list_filter(string_split(compound_id, '|'), lambda x: x <> 'AgxNull') AS c FROM points WHERE channel = 'Count' GROUP BY 1),
  nw AS (SELECT *, len(c) AS n, coalesce(list_sum(list_transform(c, lambda x: CAST(substr(x, 2) AS BIGINT))), 0) AS w FROM ns),
  nc AS (SELECT compound_id, CASE WHEN n > 0 AND w % 5 = 4 THEN NULL ELSE 6 + 18 * n + 2 * (w % 8) - CASE WHEN n > 1 AND w % 7 = 6 THEN 36 ELSE 0 END END AS center FROM nw),
  np AS (SELECT array_to_string(list_reverse(string_split(compound_id, '|')), '|') AS key, time, count * CASE abs(time - center) WHEN 0 THEN 30 WHEN 1 THEN 12 ELSE 1 END AS count
    FROM points JOIN nc USING (compound_id) WHERE channel = 'Count'),
  tr AS MATERIALIZED (SELECT key AS compound_id, 'Count' AS channel, list(time ORDER BY time) AS rt, list(count ORDER BY time) AS y FROM np GROUP BY 1)"""


def scores(out: str, places: str, points: str, sigma: float) -> str:
    """A CTE of u and info at places (node_id, tag, pos) from points (node_id, t, a, b)."""
    d = "(t - pos)"
    return f"""{out} AS MATERIALIZED (SELECT l.*, coalesce(u, 0.0) AS u, coalesce(info, 0.0) AS info FROM {places} l LEFT JOIN (
      SELECT l.node_id, l.tag, sum(exp(-{d} * {d} / {2 * sigma * sigma}) * a) AS u, sum(exp(-{d} * {d} / {sigma * sigma}) * b) AS info
      FROM {places} l JOIN {points} p ON p.node_id = l.node_id AND abs(t - pos) <= {4 * sigma} GROUP BY 1, 2) s ON s.node_id = l.node_id AND s.tag = l.tag)"""


def fit_sql(x: str, nodes: str, points: str, sigma: float) -> str:
    """CTEs up to {x}fit (node_id, low, high, step, position, u, info). nodes: node_id, low, high, step."""
    return f"""{x}g0 AS (SELECT *, unnest(range(CAST(greatest(ceil((high - low) / step), 1) AS BIGINT) + 1)) AS tag FROM {nodes}),
  {x}g AS MATERIALIZED (SELECT node_id, tag, low + step * tag AS pos FROM {x}g0 WHERE low + step * tag <= high),
  {scores(x + 'gu', x + 'g', points, sigma)},
  {x}b AS MATERIALIZED (SELECT * FROM (SELECT gu.*, low, high, step, row_number() OVER (PARTITION BY node_id ORDER BY u DESC, tag) AS best FROM {x}gu gu JOIN {nodes} USING (node_id)) WHERE best = 1),
  {x}s AS MATERIALIZED (SELECT node_id, unnest([0, 1]) AS tag, unnest([greatest(pos - step, low), least(pos + step, high)]) AS pos FROM {x}b),
  {scores(x + 'su', x + 's', points, sigma)},
  {x}sd AS (SELECT node_id, max(pos) FILTER (tag = 0) AS lp, max(pos) FILTER (tag = 1) AS rp, max(u) FILTER (tag = 0) AS lu, max(u) FILTER (tag = 1) AS ru FROM {x}su GROUP BY 1),
  {x}t AS MATERIALIZED (SELECT node_id, 0 AS tag, pos + greatest(-0.5, least(0.5, 0.5 * (lu - ru) / (lu - 2 * u + ru))) * step AS pos FROM {x}b JOIN {x}sd USING (node_id) WHERE lp < pos AND pos < rp AND lu - 2 * u + ru < -1e-12),
  {scores(x + 'tu', x + 't', points, sigma)},
  {x}fit AS MATERIALIZED (SELECT b.node_id, low, high, step, CASE WHEN t.u > b.u THEN t.pos ELSE b.pos END AS position, CASE WHEN t.u > b.u THEN t.u ELSE b.u END AS u, CASE WHEN t.u > b.u THEN t.info ELSE b.info END AS info
    FROM {x}b b LEFT JOIN {x}tu t USING (node_id))"""


def base_sql(alpha: float, peaks: str | None = None) -> str:
    """CTEs: tr, peaks (of another picker, if given) and baselines of node traces, gathered by key: nt (key, rt, y, m, v, pk:
    its peaks)."""
    return f"""{SIGNAL}, {peaks or peaks_sql(alpha, own_traces=True)}, {clipped_sql("tr", "compound_id, channel", "y", "bl")},
  kp AS (SELECT compound_id, list(struct_pack(p := p_value, rt := rt) ORDER BY rt) AS pk FROM peaks GROUP BY 1),
  nt AS MATERIALIZED (SELECT tr.compound_id AS key, rt, y, greatest(mu, 0.5) AS m, greatest(mu, 0.5) + greatest(mu, 0.5) * greatest(mu, 0.5) / coalesce(r, 1e6) AS v, coalesce(pk, []) AS pk
    FROM tr JOIN bl USING (compound_id, channel) LEFT JOIN kp ON kp.compound_id = tr.compound_id)"""


LISTS = ["initial_earliest_picks", "initial_most_significant_picks", "initial_democratic_picks", "bayesian_refined_picks"]


def consensus_sql(x: str, gate: str, tol: float, alpha: float) -> str:
    """CTEs up to {x}oc, the outcomes of the nodes of `gate` (node_id, threshold). Needs members and nt."""
    near = f"abs(p.rt - center) <= {tol}"
    reach = WINDOW * tol
    votes = "list_filter([earliest, significant, democratic], lambda q: q IS NOT NULL)"
    return f"""{x}r AS MATERIALIZED (SELECT g.node_id, threshold, threshold + {reach} AS floor, ord, coalesce(rt, []) AS rt, coalesce(y, []) AS y, m, v, coalesce(pk, []) AS pk,
      list_filter(coalesce(pk, []), lambda p: p.rt > threshold + {reach}) AS past FROM {gate} g JOIN members USING (node_id) LEFT JOIN nt USING (key)),
  {x}e AS (SELECT *, len(pk) > 0 AS active, list_min(list_transform(past, lambda p: p.rt)) AS earliest, list_sort(past)[1].rt AS significant FROM {x}r),
  {x}v AS (SELECT node_id, ord, unnest(list_transform(past, lambda p: p.rt)) AS pos FROM {x}r),
  {x}c AS (SELECT a.node_id, a.pos, count(DISTINCT b.ord) AS n FROM (SELECT DISTINCT node_id, pos FROM {x}v) a JOIN {x}v b ON b.node_id = a.node_id AND abs(b.pos - a.pos) <= {tol} GROUP BY 1, 2),
  {x}m AS (SELECT node_id, min_by(pos, {{'a': -n, 'b': pos}}) AS center FROM {x}c GROUP BY 1),
  {x}d AS MATERIALIZED (SELECT e.*, center, list_sort(list_transform(list_filter(past, lambda p: {near}), lambda p: struct_pack(d := abs(p.rt - center), rt := p.rt)))[1].rt AS democratic FROM {x}e e LEFT JOIN {x}m USING (node_id)),
  {x}n AS MATERIALIZED (SELECT node_id, any_value(threshold) AS threshold, any_value(floor) AS floor, any_value(center) AS center, CAST(count(*) AS INTEGER) AS n_all, CAST(count_if(active) AS INTEGER) AS n_active, list(earliest ORDER BY ord) AS earliest,
      list(significant ORDER BY ord) AS significant, list(democratic ORDER BY ord) AS democratic, list(ord ORDER BY ord) FILTER (NOT active) AS silent, max(significant) FILTER (active) AS only_pick,
      max(rt[-1]) FILTER (active) AS high, greatest(least(min(abs(rt[2] - rt[1]) / 2) FILTER (active AND len(rt) > 1), 0.1), 0.01) AS step, list_sort(flatten(list({votes}))) AS votes FROM {x}d GROUP BY 1),
  {x}w AS (SELECT node_id, floor AS low, high, coalesce(step, 0.1) AS step FROM {x}n WHERE n_active > 1 AND high > floor),
  {x}p0 AS (SELECT node_id, ord, m, v, unnest(rt) AS t, unnest(y) AS yy FROM {x}d WHERE active),
  {x}p AS MATERIALIZED (SELECT node_id, ord, t, (yy - m) / v AS a, 1 / v AS b FROM {x}p0),
  {fit_sql(x, x + "w", x + "p", tol)},
  {x}sh AS (SELECT f.node_id, d.ord, coalesce(sum(exp(-(t - position) * (t - position) / {2 * tol * tol}) * a) FILTER (abs(t - position) <= {4 * tol}), 0.0) AS share FROM {x}fit f JOIN {x}d d ON d.node_id = f.node_id AND d.active JOIN {x}p p ON p.node_id = d.node_id AND p.ord = d.ord GROUP BY 1, 2),
  {x}sn AS (SELECT node_id, count_if(share > 0) AS positive, list(struct_pack(o := ord, s := share) ORDER BY ord) AS shares FROM {x}sh GROUP BY 1),
  {x}z AS (SELECT *, greatest(position, low) AS score_rt, CASE WHEN info > 0 THEN u / sqrt(info) ELSE 0.0 END AS z FROM {x}fit),
  {x}k AS MATERIALIZED (SELECT n.*, score_rt, CASE WHEN score_rt IS NOT NULL THEN greatest(sqrt(1 / greatest(info, 1e-12)), z.step) END AS se, CASE WHEN score_rt IS NULL THEN NULL WHEN z > 0 THEN {normal_tail_sql("z")} ELSE 0.5 END AS p_value, positive, shares FROM {x}n n LEFT JOIN {x}z z USING (node_id) LEFT JOIN {x}sn USING (node_id)),
  {x}a AS MATERIALIZED (SELECT *, coalesce(p_value < {alpha} AND positive >= n_active // 2 + 1, false) AS agreed FROM {x}k),
  {x}l AS (SELECT node_id, votes, list_transform(list_sort(CASE WHEN score_rt > floor THEN list_append(votes, score_rt) ELSE votes END), lambda q: [q]) AS places FROM {x}a WHERE agreed),
  {x}l1 AS (SELECT node_id, votes, unnest(list_reduce(places, lambda kept, q: CASE WHEN abs(q[1] - kept[-1]) >= {tol} THEN list_concat(kept, q) ELSE kept END)) AS pos FROM {x}l WHERE len(places) > 0),
  {x}l2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY pos) AS tag FROM {x}l1),
  {scores(x + 'lu', x + 'l2', x + 'p', tol)},
  {x}lp AS (SELECT *, pow(greatest(CASE WHEN info > 0 THEN u / sqrt(info) ELSE 0.0 END, 0), 2) / 2 - coalesce(list_sum(list_transform(votes, lambda q: (q - pos) * (q - pos))), 0) / {2 * tol * tol} AS lp FROM {x}lu),
  {x}lx AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY node_id)) AS e FROM {x}lp),
  {x}lq AS (SELECT *, e / sum(e) OVER (PARTITION BY node_id) AS post, row_number() OVER (PARTITION BY node_id ORDER BY e DESC, pos) AS rank FROM {x}lx),
  {x}by AS (SELECT node_id, max(pos) FILTER (rank = 1) AS pick, max(post) FILTER (rank = 1) AS posterior, max(post) FILTER (rank = 2) AS runner_up FROM {x}lq GROUP BY 1),
  {x}o AS MATERIALIZED (SELECT a.*, pick, posterior, runner_up, coalesce(pick, score_rt) AS target, agreed OR (n_active = 1 AND only_pick IS NOT NULL) AS passed FROM {x}a a LEFT JOIN {x}by USING (node_id)),
  {x}f AS (SELECT d.node_id, list(CASE WHEN d.active THEN list_sort(list_transform(list_filter(list_zip(rt, y), lambda q: abs(q[1] - target) <= {reach}), lambda q: struct_pack(h := -q[2], rt := q[1])))[1].rt END ORDER BY ord) AS refined,
      list(ord ORDER BY ord) FILTER (d.active AND len(list_filter(pk, lambda q: abs(q.rt - target) <= {reach})) > 0) AS supporting FROM {x}o o JOIN {x}d d USING (node_id) WHERE agreed GROUP BY 1),
  {x}oc AS MATERIALIZED (SELECT node_id, passed, n_active = 0 AND n_all > 0 AS insufficient_data, threshold AS effective_threshold, score_rt AS score_test_rt, se AS score_test_rt_se, p_value AS score_test_p_value, pick AS bayesian_pick, posterior AS bayesian_pick_posterior,
      runner_up AS bayesian_pick_runner_up_posterior, (pick - threshold) / {tol} AS bayesian_pick_threshold_margin, center AS initial_democratic_position, earliest AS initial_earliest_picks, significant AS initial_most_significant_picks,
      democratic AS initial_democratic_picks, shares, coalesce(refined, list_resize(CAST([] AS DOUBLE[]), n_all)) AS bayesian_refined_picks, coalesce(supporting, []) AS bayesian_supporting_replicates, coalesce(silent, []) AS replicates_with_no_signal, n_all AS n_replicates, n_active AS n_replicates_with_signal,
      coalesce(pick, score_rt, significant[1]) AS chosen_rt, coalesce(pick, score_rt, list_filter(significant, lambda q: q IS NOT NULL)[1]) AS display_rt FROM {x}o LEFT JOIN {x}f USING (node_id))"""


def stepwise(sql: str) -> str:
    """Every CTE is worked out once, as inlined ones are again and again."""
    return re.sub(r"(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", sql)


def pedigree_sql(tol: float, alpha: float, tiers: int = 3) -> str:
    """CTEs up to `oc`, the outcomes of the whole pedigree. Needs members, nodes, edges."""
    none = "CAST([NULL] AS DOUBLE[])"
    root = f"""t0oc AS MATERIALIZED (SELECT m.node_id, len(coalesce(pk, [])) > 0 AS passed, len(coalesce(pk, [])) = 0 AS insufficient_data, CAST(NULL AS DOUBLE) AS effective_threshold, CAST(NULL AS DOUBLE) AS score_test_rt, CAST(NULL AS DOUBLE) AS score_test_rt_se,
      CAST(NULL AS DOUBLE) AS score_test_p_value, CAST(NULL AS DOUBLE) AS bayesian_pick, CAST(NULL AS DOUBLE) AS bayesian_pick_posterior, CAST(NULL AS DOUBLE) AS bayesian_pick_runner_up_posterior, CAST(NULL AS DOUBLE) AS bayesian_pick_threshold_margin,
      CAST(NULL AS DOUBLE) AS initial_democratic_position, [pk[1].rt] AS initial_earliest_picks, [list_sort(pk)[1].rt] AS initial_most_significant_picks, {none} AS initial_democratic_picks, NULL AS shares, {none} AS bayesian_refined_picks,
      CAST([] AS INTEGER[]) AS bayesian_supporting_replicates, CAST([] AS INTEGER[]) AS replicates_with_no_signal, CAST(1 AS INTEGER) AS n_replicates, CAST(len(coalesce(pk, [])) > 0 AS INTEGER) AS n_replicates_with_signal,
      list_sort(pk)[1].rt AS chosen_rt, list_sort(pk)[1].rt AS display_rt FROM members m LEFT JOIN nt USING (key) WHERE tier = 0)"""
    steps, so_far = [root], "SELECT * FROM t0oc"
    for t in range(1, tiers + 1):
        steps.append(f"""u{t} AS MATERIALIZED ({so_far}),
  q{t} AS MATERIALIZED (SELECT child_id AS node_id, max(chosen_rt) AS threshold FROM edges JOIN nodes n ON n.node_id = child_id AND n.tier = {t} LEFT JOIN u{t} u ON u.node_id = parent_id GROUP BY 1 HAVING bool_and(coalesce(passed AND chosen_rt IS NOT NULL, false))),
  {consensus_sql(f"t{t}", f"q{t}", tol, alpha)}""")
        so_far += f" UNION ALL BY NAME SELECT * FROM t{t}oc"
    return ",\n".join([*steps, f"oc AS MATERIALIZED ({so_far})"])


NUMBERS = [
    "effective_threshold", "score_test_rt", "score_test_rt_se", "score_test_p_value", "bayesian_pick", "bayesian_pick_posterior",
    "bayesian_pick_runner_up_posterior", "bayesian_pick_threshold_margin", "initial_democratic_position", "chosen_rt", "display_rt",
]


def shown_sql(source: str, scale: int = 1) -> str:
    """Outcomes as plain columns: rounded numbers, and lists as text (times in 1 / scale months, `-` for none)."""
    number = lambda c: f"CAST(round(q * {scale}) AS INTEGER)" if scale > 1 and c in LISTS else "CAST(q AS INTEGER)"
    whole = lambda c: f"array_to_string(list_transform({c}, lambda q: coalesce(CAST({number(c)} AS VARCHAR), '-')), ' ') AS {c}"
    lists = [*LISTS, "bayesian_supporting_replicates", "replicates_with_no_signal"]
    return f"""SELECT node_id, passed, insufficient_data, {", ".join(f"round({c}, 5) AS {c}" for c in NUMBERS)}, {", ".join(whole(c) for c in lists)},
  round(list_sum(list_transform(shares, lambda q: q.s)), 4) AS score_contribution, n_replicates, n_replicates_with_signal FROM {source}"""
