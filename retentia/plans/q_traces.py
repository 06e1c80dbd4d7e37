"""Queries of windows over traces, peak picking, signal statistics and what is counted from them (W, T01-T06, A06-A14, A21)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import signal as G
from ..functions import tails
from ..operators import metrics as M
from ..operators import parse as P
from ..operators import traces as T
from . import library as L
from .catalog import query
from .gaussian_sql import gaussian_peaks_sql
from .q_aggregates import TOTALS, histogram_sql, rounded, stats_sql
from .q_ingest import SHEET, ingested, sheet_sql

ALPHA = 0.05
TR = "tr AS (SELECT compound_id, channel, list(time ORDER BY time) AS rt, list(count ORDER BY time) AS y FROM points GROUP BY 1, 2)"


def clipped_sql(source: str, keys: str, values: str, out: str) -> str:
    """CTEs from `source` (keys, values: a list) to `out` (keys, mu, sigma, r): ten unrolled rounds of clipping."""
    steps = [f"{out}0 AS (SELECT {keys}, {values} AS k FROM {source})"]
    for i in range(1, 11):
        mean = f"SELECT {keys}, k, list_avg(k) AS m FROM {out}{i - 1}"
        cut = f"SELECT {keys}, k, m + 2 * sqrt(list_avg(list_transform(k, lambda x: (x - m) * (x - m)))) AS c FROM ({mean})"
        inner = f"SELECT {keys}, k, c, list_filter(k, lambda x: x <= c) AS f FROM ({cut})"
        steps.append(f"{out}{i} AS (SELECT {keys}, CASE WHEN len(f) < 3 THEN k ELSE f END AS k FROM ({inner}))")
    steps.append(f"{out}m AS (SELECT {keys}, k, list_median(k) AS mu FROM {out}10)")
    steps.append(f"{out}v AS (SELECT {keys}, mu, list_avg(list_transform(k, lambda x: (x - mu) * (x - mu))) AS var FROM {out}m)")
    steps.append(f"{out} AS (SELECT {keys}, mu, sqrt(var) AS sigma, CASE WHEN var > mu AND mu > 1e-9 THEN mu * mu / (var - mu) END AS r FROM {out}v)")
    return ",\n".join(steps)


def tail_sql(k: str, mu: str, r: str) -> str:
    """P(X >= k) as 1 minus a sum of the mass function."""
    n = f"CAST(greatest(1, floor({k} + 0.5)) AS BIGINT)"
    mass = f"CASE WHEN {r} IS NULL THEN exp(j * ln({mu}) - {mu} - lgamma(j + 1)) ELSE exp(lgamma({r} + j) - lgamma({r}) - lgamma(j + 1) + {r} * ln({r} / ({r} + {mu})) + j * ln({mu} / ({r} + {mu}))) END"
    return f"CASE WHEN {k} <= 0 THEN 1.0 WHEN {mu} <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - list_sum(list_transform(range({n}), lambda j: {mass})))) END"


def normal_tail_sql(z: str) -> str:
    """P(Z >= z) by the power series of the distribution about 0; 0 or 1 beyond 8."""
    odd = f"list_sum(list_transform(range(250), lambda j: exp((2 * j + 1) * ln(abs({z})) - ((j + 1) * ln(2) + lgamma(j + 1.5) - 0.5 * ln(pi())))))"
    inner = f"0.5 - sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {odd}"
    return f"CASE WHEN {z} > 8 THEN 0.0 WHEN {z} < -8 THEN 1.0 WHEN {z} = 0 THEN 0.5 ELSE {inner} END"


MAXIMA = """nm AS (SELECT compound_id, channel, rt, y, unnest(range(2, len(y))) AS i FROM tr),
  mx AS (SELECT *, y[i] AS h FROM (SELECT *, list_min(list_filter(range(i + 1, len(y) + 1), lambda j: y[j] <> y[i])) AS nxt FROM nm WHERE y[i - 1] < y[i]) WHERE nxt IS NOT NULL AND y[nxt] < y[i])"""
BOUNDS = """bd AS (SELECT *, coalesce(list_max(list_filter(range(2, i + 1), lambda l: y[l - 1] >= y[l])), 1) AS lft, coalesce(list_min(list_filter(range(i, len(y)), lambda q: y[q + 1] >= y[q])), len(y)) AS rgt FROM mx),
  pr AS (SELECT *, h - greatest(least(h, coalesce(list_min(y[coalesce(list_max(list_filter(range(1, i), lambda l: y[l] > h)), 0) + 1 : i - 1]), h)),
      least(h, coalesce(list_min(y[i + 1 : coalesce(list_min(list_filter(range(i + 1, len(y) + 1), lambda q: y[q] > h)), len(y) + 1) - 1]), h))) AS prominence FROM bd),
  ar AS (SELECT *, list_transform(list_filter(range(greatest(1, i - least(30, len(y) // 2)), least(len(y), i + least(30, len(y) // 2)) + 1), lambda q: q < lft OR q > rgt), lambda q: y[q]) AS around FROM pr)"""
LOCAL = clipped_sql("ar", "compound_id, channel, i", "around", "lb")


def peaks_sql(alpha: float = ALPHA, own_traces: bool = False) -> str:
    """CTEs up to peaks, from points (tr comes with them, unless own_traces brings it)."""
    picked = f"""cand AS (SELECT ar.*, mu, sigma, r, rgt - lft + 1 AS w, list_sum(y[lft : rgt]) AS area FROM ar JOIN lb USING (compound_id, channel, i) WHERE h > mu),
  pv AS (SELECT *, {tail_sql("h", "mu", "r")} AS p_h, {tail_sql("area", "(mu * w)", "(r * w)")} AS p_a FROM cand),
  peaks AS (SELECT compound_id, channel, rt[i] AS rt, h AS intensity, area, prominence, least(p_h, p_a) AS p_value, rt[lft] AS left_rt, rt[rgt] AS right_rt,
      CAST(row_number() OVER (PARTITION BY compound_id, channel ORDER BY i) AS INTEGER) AS peak, 100 * area / sum(area) OVER (PARTITION BY compound_id, channel) AS pct_area FROM pv WHERE p_h < {alpha / 2} AND p_a < {alpha / 2})"""
    return ",\n".join([*([] if own_traces else [TR]), MAXIMA, BOUNDS, LOCAL, picked])


def old_peaks_sql(options: G.GaussianOptions) -> str:
    """CTEs from tr to the Gaussian picker's peaks."""
    return gaussian_peaks_sql(options, MAXIMA, BOUNDS.replace("FROM mx", "FROM fitted"))


PEAKS_SQL = peaks_sql()
#: The Gaussian picker's options in these queries.
OLD = G.GaussianOptions(minimum_rt=5.0)
OLD_LATE = G.GaussianOptions(minimum_rt=12.0, height_factor=0.6)
BASE_SQL = clipped_sql("tr", "compound_id, channel", "y", "bl")
STATS_SQL = f"""{PEAKS_SQL}, {BASE_SQL}, best AS (SELECT compound_id, channel, count(*) AS peak_count, max(prominence) AS max_prominence, median(prominence) AS median_prominence,
    max(intensity) AS height, min_by(rt, {{'a': -intensity, 'b': rt}}) AS tall_rt FROM peaks GROUP BY 1, 2),
  stats AS (SELECT compound_id, channel, mu AS baseline_mu, sigma AS baseline_sigma, coalesce(peak_count, 0) AS peak_count, coalesce(peak_count, 0) > 0 AS has_peak,
    coalesce(max_prominence, 0) AS max_prominence, median_prominence, coalesce(height, 0) AS tallest_peak_height, coalesce(tall_rt, tr.rt[1]) AS tallest_peak_rt,
    coalesce(height, 0) - mu AS snr_excess, CASE WHEN sigma > 1e-12 THEN (coalesce(height, 0) - mu) / sigma END AS snr_ratio, CASE WHEN mu > 1e-12 THEN coalesce(height, 0) / mu END AS dynamic_range
    FROM tr JOIN bl USING (compound_id, channel) LEFT JOIN best USING (compound_id, channel) WHERE len(tr.rt) >= 3)"""
ROUND_PEAKS = "SELECT compound_id, channel, peak, rt, intensity, area, prominence, round(p_value, 6) AS p_value, round(pct_area, 4) AS pct_area, left_rt, right_rt FROM peaks"


def library_traces(spark, d):
    return P.traces(L.points(spark, d))


def library_peaks(spark, d, **options):
    return T.pick(library_traces(spark, d), alpha=ALPHA, **options)


def library_stats(spark, d):
    return T.signal_stats(library_traces(spark, d), ALPHA)


@query("w02_local_maxima", L.sql("points", f"{TR}, {MAXIMA} SELECT compound_id, channel, rt[i] AS time, h AS count FROM mx"))
def w02(spark, d):
    return T.maxima(L.points(spark, d))


@query("w03_valley_bounds", L.sql("points", f"""{TR}, al AS (SELECT compound_id, channel, rt, y, unnest(range(1, len(y) + 1)) AS i FROM tr)
  SELECT compound_id, channel, rt[i] AS time, y[i] AS count, rt[coalesce(list_max(list_filter(range(2, i + 1), lambda l: y[l - 1] >= y[l])), 1)] AS left_rt, rt[coalesce(list_min(list_filter(range(i, len(y)), lambda q: y[q + 1] >= y[q])), len(y))] AS right_rt FROM al"""))
def w03(spark, d):
    return T.valleys(L.points(spark, d))


@query("w04_prominence", L.sql("points", f"{TR}, {MAXIMA}, {BOUNDS} SELECT compound_id, channel, rt[i] AS rt, prominence FROM pr"))
def w04(spark, d):
    return T.apexes(library_traces(spark, d)).select("compound_id", "channel", "rt", "prominence")


@query("w05_rolling_baseline", L.sql("points", f"{TR}, {MAXIMA}, {BOUNDS}, {LOCAL} SELECT compound_id, channel, rt[i] AS rt, round(mu, 6) AS local_mu, round(sigma, 6) AS local_sigma FROM ar JOIN lb USING (compound_id, channel, i)"))
def w05(spark, d):
    return rounded(T.apexes(library_traces(spark, d)).select("compound_id", "channel", "rt", "local_mu", "local_sigma"), "local_mu", "local_sigma")


@query("w07_peak_numbering", L.sql("points", f"{PEAKS_SQL} SELECT compound_id, channel, peak, round(pct_area, 6) AS pct_area FROM peaks"))
def w07(spark, d):
    return rounded(library_peaks(spark, d).select("compound_id", "channel", "peak", "pct_area"), "pct_area")


@query("w08_direct_pick", L.sql("points", f"{PEAKS_SQL} SELECT compound_id, channel, max(rt) AS rt FROM peaks GROUP BY 1, 2"))
def w08(spark, d):
    return T.direct_rt(library_peaks(spark, d))


@query("w08b_direct_pick_old_way", L.sql("points", f"{PEAKS_SQL}, top AS (SELECT compound_id, channel, max(count) AS m FROM points GROUP BY 1, 2) SELECT compound_id, channel, max(rt) AS rt FROM peaks JOIN top USING (compound_id, channel) WHERE rt >= 12 AND intensity >= 0.6 * m GROUP BY 1, 2"))
def w08_old(spark, d):
    return T.direct_rt(library_peaks(spark, d), M.entry_maxima(L.points(spark, d)), minimum_rt=12.0, factor=0.6)


@query("w08c_direct_pick_gaussian", L.sql("points", f"{TR}, {old_peaks_sql(OLD_LATE)}, top AS (SELECT compound_id, channel, max(count) AS m FROM points GROUP BY 1, 2) SELECT compound_id, channel, round(max(rt), 6) AS rt FROM peaks JOIN top USING (compound_id, channel) WHERE rt >= 12 AND intensity >= 0.6 * m GROUP BY 1, 2"))
def w08_gaussian(spark, d):
    """The old way throughout: Gaussian fits, then the gates of time and height."""
    found = T.pick(library_traces(spark, d), "gaussian", options=OLD_LATE)
    late = T.direct_rt(found, M.entry_maxima(L.points(spark, d)), OLD_LATE.minimum_rt, OLD_LATE.height_factor)
    return rounded(late, "rt")


@query("w09_stage1_picks", L.sql("points", f"{PEAKS_SQL} SELECT compound_id, channel, min(rt) AS earliest, min_by(rt, {{'a': p_value, 'b': rt}}) AS most_significant FROM (SELECT * REPLACE (round(p_value, 9) AS p_value) FROM peaks) WHERE rt > 20 GROUP BY 1, 2"))
def w09(spark, d):
    return T.peak_picks(rounded(library_peaks(spark, d), "p_value", digits=9), 20.0)


BROAD = f"""{PEAKS_SQL}, pk AS (SELECT split_part(compound_id, '|', 1) AS cls, compound_id, rt FROM peaks WHERE channel = 'Count' AND rt > 5),
  cand2 AS (SELECT DISTINCT cls, rt AS pos FROM pk), sup AS (SELECT c.cls, c.pos, count(DISTINCT p.compound_id) AS n FROM cand2 c JOIN pk p ON p.cls = c.cls AND abs(p.rt - c.pos) <= 1.5 GROUP BY 1, 2),
  cen AS (SELECT cls, min_by(pos, {{'a': -n, 'b': pos}}) AS center FROM sup GROUP BY 1)
  SELECT cls, center, compound_id, min_by(rt, {{'a': abs(rt - center), 'b': rt}}) FILTER (abs(rt - center) <= 1.5) AS pick FROM cen JOIN pk USING (cls) GROUP BY 1, 2, 3"""


@query("w10_broadest_agreement", L.sql("points", BROAD))
def w10(spark, d):
    from ..operators.joins import broadest_agreement

    pk = library_peaks(spark, d).where("channel = 'Count' and rt > 5").select(F.split("compound_id", r"\|")[0].alias("cls"), "compound_id", "rt")
    return broadest_agreement(pk, 1.5)


@query("w11_nearest_sample", L.sql("points", "n AS (SELECT *, row_number() OVER (PARTITION BY compound_id, channel ORDER BY time) - 1 AS place FROM points) SELECT compound_id, channel, CAST(min_by(place, {'a': abs(time - 40.5), 'b': place}) AS INTEGER) AS place, min_by(time, {'a': abs(time - 40.5), 'b': place}) AS time FROM n GROUP BY 1, 2"))
def w11(spark, d):
    return T.nearest_sample(library_traces(spark, d), 40.5)


@query("c12_count_tail", L.sql("points", f"{TR}, {BASE_SQL}, q AS (SELECT compound_id, channel, list_max(y) AS top, mu, r FROM tr JOIN bl USING (compound_id, channel) WHERE channel = 'Count') SELECT compound_id, top, round({tail_sql('top', 'mu', 'r')}, 6) AS p FROM q"))
def c12(spark, d):
    tr = library_traces(spark, d).where("channel = 'Count'")
    b = T.baselines(tr).join(tr.select("compound_id", F.array_max("y").alias("top")), "compound_id")
    return b.select("compound_id", "top", F.round(tails.count_tail("top", "baseline_mu", "dispersion"), 6).alias("p"))


@query("c13_normal_tail", L.sql("parts", f"z AS (SELECT *, (count - 2) / 3 AS z FROM parts) SELECT compound_id, channel, time, round({normal_tail_sql('z')}, 9) AS p FROM z"))
def c13(spark, d):
    return L.parts(spark, d).select("compound_id", "channel", "time", F.round(tails.normal_tail((F.col("count") - 2) / 3), 9).alias("p"))


@query("t01_clipped_baseline", L.sql("points", f"{TR}, {BASE_SQL} SELECT compound_id, channel, round(mu, 6) AS baseline_mu, round(sigma, 6) AS baseline_sigma, round(r, 4) AS dispersion FROM bl"))
def t01(spark, d):
    b = T.baselines(library_traces(spark, d))
    return rounded(rounded(b, "baseline_mu", "baseline_sigma"), "dispersion", digits=4)


@query("t02_modern_picker", L.sql("points", f"{PEAKS_SQL} {ROUND_PEAKS}"))
def t02(spark, d):
    return rounded(rounded(library_peaks(spark, d), "p_value"), "pct_area", digits=4)


@query("t03_gaussian_picker", L.sql("points", f"{TR}, {old_peaks_sql(OLD)} {ROUND_PEAKS.replace(' rt,', ' round(rt, 6) AS rt,', 1)}"))
def t03(spark, d):
    return rounded(rounded(T.pick(library_traces(spark, d), "gaussian", options=OLD), "rt", "p_value"), "pct_area", digits=4)


QUALITY = "q AS (SELECT *, 100 * area / sum(area) OVER (PARTITION BY compound_id, channel) AS pct FROM peaks)"


@query("p21_quality_filter", L.sql("points", f"{PEAKS_SQL}, {QUALITY} SELECT compound_id, channel, rt, prominence FROM q WHERE prominence >= 5 AND pct >= 20"))
def p21(spark, d):
    return library_peaks(spark, d, min_prominence=5.0, min_pct_area=20.0).select("compound_id", "channel", "rt", "prominence")


@query("p22_truncation_rescue", L.sql("points", f"{PEAKS_SQL}, {QUALITY} SELECT compound_id, channel, rt, prominence, prominence >= 5 AND pct >= 20 AS passes FROM q WHERE contains(compound_id, 'AgxNull') OR (prominence >= 5 AND pct >= 20)"))
def p22(spark, d):
    passes = (F.col("prominence") >= 5) & (F.col("pct_area") >= 20)
    p = library_peaks(spark, d).withColumn("passes", passes)
    return p.where(F.col("compound_id").contains("AgxNull") | F.col("passes")).select("compound_id", "channel", "rt", "prominence", "passes")


@query("t04_peak_analysis", L.sql("points", f"{PEAKS_SQL}, {BASE_SQL} SELECT p.compound_id, p.channel, count(*) AS n_peaks, round(sum(area), 6) AS area, round(any_value(mu), 6) AS baseline_mu FROM peaks p JOIN bl b ON b.compound_id = p.compound_id AND b.channel = p.channel GROUP BY 1, 2"))
def t04(spark, d):
    return T.analyse(library_traces(spark, d), alpha=ALPHA).groupBy("compound_id", "channel").agg(F.count("*").alias("n_peaks"), F.round(F.sum("area"), 6).alias("area"), F.round(F.first("baseline_mu"), 6).alias("baseline_mu"))


@query("t04_failures", L.sql("parts", "SELECT compound_id, channel, 'fewer than 3 points' AS error FROM parts GROUP BY 1, 2 HAVING count(*) < 3"))
def t04_failures(spark, d):
    return T.failures(P.traces(L.parts(spark, d)))


@query("t04b_peak_analysis_peaks", L.sql("points", f"""{PEAKS_SQL}, {BASE_SQL}, {QUALITY} SELECT compound_id, channel, CAST(row_number() OVER (PARTITION BY compound_id, channel ORDER BY rt) AS INTEGER) AS peak, rt, intensity, area, prominence, round(p_value, 6) AS p_value,
  round(pct, 4) AS pct_area, left_rt, right_rt, round(mu, 6) AS baseline_mu, round(sigma, 6) AS baseline_sigma, round(r, 4) AS dispersion FROM q JOIN bl USING (compound_id, channel) WHERE prominence >= 5 AND pct >= 20"""))
def t04_peaks(spark, d):
    found = T.analyse(library_traces(spark, d), alpha=ALPHA, min_prominence=5.0, min_pct_area=20.0)
    return rounded(rounded(found, "p_value", "baseline_mu", "baseline_sigma"), "pct_area", "dispersion", digits=4)


@query("t04c_failures_of_pairs", "SELECT 'P' || l_partkey || '|S' || l_suppkey AS compound_id, 'Count' AS channel, 'fewer than 3 points' AS error FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT date_trunc('month', l_shipdate)) < 3")
def t04_failing(spark, d):
    t = L.table(spark, d, "lineitem")
    pair = F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("|S"), F.col("l_suppkey").cast("string"))
    rows = L.by_compound(spark, d, t.select(pair.alias("compound_id"), L.months(F.col("l_shipdate")).alias("time")))
    p = rows.groupBy("compound_id", "time").agg(F.count("*").cast("double").alias("count"))
    return T.failures(P.traces(p.select("compound_id", F.lit("Count").alias("channel"), "time", "count")))


STATS_COLUMNS = ["baseline_mu", "baseline_sigma", "max_prominence", "median_prominence", "snr_excess", "snr_ratio", "dynamic_range"]


@query("t05_signal_stats", L.sql("points", f"{STATS_SQL} SELECT compound_id, channel, peak_count, has_peak, tallest_peak_height, tallest_peak_rt, {', '.join(f'round({c}, 6) AS {c}' for c in STATS_COLUMNS)} FROM stats"))
def t05(spark, d):
    return rounded(library_stats(spark, d), *STATS_COLUMNS)


@query("t06_library_scan", sheet_sql("SELECT count(*) AS attempted, count_if(reason IS NULL) AS used, count_if(reason IS NOT NULL) AS skipped, sum(CASE WHEN reason IS NULL THEN len(pts) END) AS points FROM ingested"))
def t06(spark, d):
    rows = ingested(spark, d)
    ok = F.col("reject_reason").isNull()
    return rows.agg(F.count("*").alias("attempted"), F.count_if(ok).alias("used"), F.count_if(~ok).alias("skipped"), F.sum(F.when(ok, F.size("points"))).cast("double").alias("points"))


@query("t06b_library_scan_traces", sheet_sql(""", pz AS (SELECT row_no, compound_id, unnest(list_transform(list_sort(list_transform(pts, lambda p: {'t': p.t, 'na': p.a IS NULL, 'a': coalesce(p.a, -1), 'b': coalesce(p.b, -1)})), lambda p, i: {'p': p, 'i': i - 1})) AS x FROM ingested WHERE reason IS NULL)
  SELECT row_no, compound_id, NULL AS reject_reason, CAST(x.i AS INTEGER) AS place, x.p.t AS time, 'Count' AS channel, x.p.a AS count FROM pz WHERE x.p.a >= 0
  UNION ALL SELECT row_no, compound_id, NULL, CAST(x.i AS INTEGER), x.p.t, 'Scaled', x.p.b FROM pz WHERE x.p.b >= 0 UNION ALL SELECT row_no, compound_id, reason, NULL, NULL, NULL, NULL FROM ingested WHERE reason IS NOT NULL"""))
def t06_traces(spark, d):
    return P.scan(ingested(spark, d))


_METRIC_IDS = {
    "a06": "baseline_mu_library", "a07": "baseline_sigma_library", "a08": "tallest_significant_peak_height_mean", "a09": "tallest_significant_snr_excess_mean",
    "a10": "tallest_significant_snr_ratio_mean", "a11": "tallest_significant_dynamic_range_mean", "a12": "fraction_with_significant_peak",
    "a13": "significant_peak_count_mean", "a14": "max_significant_prominence_mean", "a14b": "median_significant_prominence_mean",
}


def _metric(name, spark, d):
    return rounded(M.signal_metric(library_stats(spark, d), name), "mean", "std_dev")


for _id, _name in _METRIC_IDS.items():
    query(f"{_id}_{_name}", L.sql("points", f"{STATS_SQL} {stats_sql(f'CAST({M.SIGNAL_METRICS[_name]} AS DOUBLE)', 'stats')}"))(partial(_metric, _name))

#: Plot data: name -> (column of signal_stats).
PLOTS = {"snr_excess": "snr_excess", "snr_ratio": "snr_ratio", "dynamic_range": "dynamic_range", "max_prominence": "max_prominence", "baseline_mu": "baseline_mu"}


def _plot(column, spark, d):
    return rounded(M.histogram(rounded(library_stats(spark, d), column), column), "left_edge", digits=4)


for _name, _column in PLOTS.items():
    _body = f"{STATS_SQL}, st AS (SELECT channel, round({_column}, 6) AS v FROM stats), {histogram_sql('st', 'v').replace('round(lo + bin * ((hi - lo) / 50), 6)', 'round(lo + bin * ((hi - lo) / 50), 4)')}"
    query(f"a21_plot_{_name}", L.sql("points", _body))(partial(_plot, _column))


@query("a21_plot_total_count", L.sql("parts", TOTALS + ", " + histogram_sql("totals", "total")))
def a21_total(spark, d):
    return rounded(M.histogram(M.entry_totals(L.parts(spark, d)), "total"), "left_edge")


@query("a21_plot_max_count", L.sql("parts", "mx AS (SELECT compound_id, channel, max(count) AS m FROM parts GROUP BY 1, 2), " + histogram_sql("mx", "m")))
def a21_max(spark, d):
    return rounded(M.histogram(M.entry_maxima(L.parts(spark, d)), "max_count"), "left_edge")


@query("a21_plot_peak_count", L.sql("points", f"""{STATS_SQL}, c AS (SELECT channel, CAST(peak_count AS INTEGER) AS bin, count(*) AS n FROM stats GROUP BY 1, 2),
  b AS (SELECT channel, CAST(unnest(range(max(bin) + 1)) AS INTEGER) AS bin FROM c GROUP BY channel) SELECT channel, bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (channel, bin)"""))
def a21_peaks(spark, d):
    return M.integer_histogram(library_stats(spark, d), "peak_count")


@query("a21_plot_fraction_line", L.sql("parts", "fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY compound_id, channel ORDER BY time) AS INTEGER) AS fraction FROM parts) SELECT channel, fraction, round(avg(count), 6) AS mean_count FROM fr GROUP BY 1, 2"))
def a21_line(spark, d):
    return rounded(M.fraction_means(L.parts(spark, d)), "mean_count")
