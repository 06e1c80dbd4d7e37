"""The Gaussian picker in SQL: the fit's rounds are a recursive CTE, a row for each peak and round."""

from __future__ import annotations

from ..functions.signal import GaussianOptions

ROUNDS = 200


def loss(a: str, m: str, s: str) -> str:
    return f"list_sum(list_transform(pts, lambda p: pow(p.v - {a} * exp(-pow((p.x - {m}) / (2 * {s}), 2)), 2)))"


def trials(source: str) -> str:
    """Six steps, up and down along each axis; one that lowers the loss is taken."""
    at = source
    for axis in "ams":
        for sign in "+-":
            a, m, s = ("tried" if axis == c else c for c in "ams")
            tried = f"SELECT *, greatest(least({axis} {sign} step_{axis}, most_{axis}), low_{axis}) AS tried FROM ({at})"
            at = f"SELECT * EXCLUDE (tried, now) REPLACE (CASE WHEN now < best THEN tried ELSE {axis} END AS {axis}, least(now, best) AS best) FROM (SELECT *, {loss(a, m, s)} AS now FROM ({tried}))"
    return at


def gaussian_peaks_sql(o: GaussianOptions, maxima: str, bounds: str) -> str:
    """CTEs up to peaks, from tr. maxima: CTEs up to mx, the local maxima; bounds: CTEs from `fitted` up to ar, which has valley
    bounds and prominence."""
    return f"""{maxima},
  tall AS (SELECT *, row_number() OVER (ORDER BY compound_id, channel, i) AS id, list_max(y) * {o.height_factor} AS cut, list_transform(list_filter(range(1, len(rt) + 1), lambda j: abs(rt[j] - rt[i]) < {o.fit_width}), lambda j: struct_pack(x := rt[j], v := y[j])) AS pts
    FROM mx WHERE list_max(y) > 0 AND h >= list_max(y) * {o.height_factor} AND rt[i] >= {o.minimum_rt}),
  high AS (SELECT id, pts, rt[i] AS c, list_max(list_transform(pts, lambda p: p.v)) AS a, list_avg(list_transform(pts, lambda p: p.x)) AS mid FROM tall WHERE len(pts) >= 3),
  wide AS (SELECT *, greatest(sqrt(list_avg(list_transform(pts, lambda p: (p.x - mid) * (p.x - mid)))) / 2, 1e-6) AS s FROM high),
  begun AS (SELECT id, pts, a, c AS m, s, greatest(a / 10, 1.0) AS step_a, greatest({o.fit_width} / 20, 1e-4) AS step_m, greatest(s / 10, 1e-4) AS step_s, 0.0 AS low_a, c - {o.fit_width} AS low_m, 1e-6 AS low_s,
    CAST('inf' AS DOUBLE) AS most_a, c + {o.fit_width} AS most_m, CAST('inf' AS DOUBLE) AS most_s, {loss("a", "c", "s")} AS best FROM wide),
  fits AS (WITH RECURSIVE fit AS (
      SELECT *, CAST('inf' AS DOUBLE) AS before, 0 AS round FROM begun
      UNION ALL
      SELECT * REPLACE (round + 1 AS round) FROM ({trials("SELECT * REPLACE (best AS before) FROM fit WHERE best < before AND round < " + str(ROUNDS))}))
    SELECT id, max_by(struct_pack(a := a, m := m, s := s), round) AS f FROM fit GROUP BY id),
  near AS (SELECT tall.*, f.a AS fa, f.m AS fm, f.s AS fs, list_transform(rt, lambda t: abs(t - f.m)) AS away FROM tall JOIN fits USING (id) WHERE f.s < {o.stddev_limit} AND f.a >= cut AND f.m >= {o.minimum_rt}),
  fitted AS (SELECT * REPLACE (place AS i, y[place] AS h) FROM (SELECT *, h AS top, i AS apex, list_position(away, list_min(away)) AS place FROM near)),
  {bounds},
  pz AS (SELECT *, list_sum(y[lft : rgt]) AS area, sqrt(list_avg(list_transform(pts, lambda p: pow(p.v - fa * exp(-pow((p.x - fm) / (2 * fs), 2)), 2)))) AS error FROM ar),
  peaks AS (SELECT compound_id, channel, fm AS rt, top AS intensity, area, prominence, least(1.0, error / greatest(fa, 1e-9)) AS p_value, rt[lft] AS left_rt, rt[rgt] AS right_rt,
    CAST(row_number() OVER (PARTITION BY compound_id, channel ORDER BY fm, apex) AS INTEGER) AS peak, 100 * area / sum(area) OVER (PARTITION BY compound_id, channel) AS pct_area FROM pz)"""
