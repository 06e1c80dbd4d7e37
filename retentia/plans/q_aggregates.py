"""Queries of library metrics and plot data (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import library as L
from .catalog import query

TOTALS = "totals AS (SELECT compound_id, channel, sum(count) AS total FROM parts GROUP BY 1, 2)"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def stats_sql(value: str, source: str) -> str:
    return f"SELECT channel, round(avg({value}), 6) AS mean, round(coalesce(stddev_samp({value}), 0), 6) AS std_dev, count({value}) AS n FROM {source} GROUP BY 1"


@query("a01_entry_total", L.sql("parts", "SELECT compound_id, channel, sum(count) AS total FROM parts GROUP BY 1, 2"))
def a01(spark, d):
    return M.entry_totals(L.parts(spark, d))


@query("a02_channel_stats", L.sql("parts", stats_sql("count", "parts")))
def a02(spark, d):
    return rounded(M.channel_stats(L.parts(spark, d), "count"), "mean", "std_dev")


@query("a03_total_count_per_entry", L.sql("parts", TOTALS + stats_sql("total", "totals").replace("SELECT", " SELECT", 1)))
def a03(spark, d):
    return rounded(M.total_count_per_entry(L.parts(spark, d)), "mean", "std_dev")


@query("a04_avg_count_per_fraction", L.sql("parts", TOTALS + " " + stats_sql("total / 96", "totals")))
def a04(spark, d):
    return rounded(M.avg_count_per_fraction(L.parts(spark, d)), "mean", "std_dev")


@query("a05_library_coverage_index", L.sql("parts", TOTALS + " SELECT channel, round(sum(total) / (count(*) * 96), 6) AS mean, 0.0 AS std_dev, count(*) AS n FROM totals GROUP BY 1"))
def a05(spark, d):
    return rounded(M.coverage_index(L.parts(spark, d)), "mean")


@query("a15_max_count", L.sql("parts", "SELECT compound_id, channel, max(count) AS max_count FROM parts GROUP BY 1, 2"))
def a15(spark, d):
    return M.entry_maxima(L.parts(spark, d))


FRACTIONS = "fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY compound_id, channel ORDER BY time) AS INTEGER) AS fraction FROM parts)"


@query("a16_fraction_totals", L.sql("parts", FRACTIONS + " SELECT channel, fraction, sum(count) AS total, count(*) AS entries FROM fr GROUP BY 1, 2"))
def a16(spark, d):
    return M.fraction_totals(L.parts(spark, d))


@query("a17_mean_of_fraction_means", L.sql("parts", FRACTIONS + ", fm AS (SELECT channel, fraction, avg(count) AS m FROM fr GROUP BY 1, 2) " + stats_sql("m", "fm")))
def a17(spark, d):
    return rounded(M.mean_of_fraction_means(L.parts(spark, d)), "mean", "std_dev")


def histogram_sql(source: str, value: str, bins: int = 50) -> str:
    return f"""ends0 AS (SELECT channel, min({value}) AS lo, max({value}) AS hi FROM {source} GROUP BY 1),
      ends AS (SELECT channel, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM ends0),
      counted AS (SELECT channel, least({bins - 1}, CAST(floor(({value} - lo) / ((hi - lo) / {bins})) AS INTEGER)) AS bin, count(*) AS n FROM {source} JOIN ends USING (channel) WHERE {value} IS NOT NULL GROUP BY 1, 2),
      bins AS (SELECT channel, lo, hi, CAST(unnest(range({bins})) AS INTEGER) AS bin FROM ends)
      SELECT channel, bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS left_edge, coalesce(n, 0) AS n FROM bins LEFT JOIN counted USING (channel, bin)"""


@query("a18_histogram", L.sql("parts", TOTALS + ", " + histogram_sql("totals", "total")))
def a18(spark, d):
    return rounded(M.histogram(M.entry_totals(L.parts(spark, d)), "total"), "left_edge")


@query("a19_integer_histogram", L.sql("parts", TOTALS + """, c AS (SELECT channel, CAST(floor(total + 0.5) AS INTEGER) AS bin, count(*) AS n FROM totals GROUP BY 1, 2),
  b AS (SELECT channel, CAST(unnest(range(max(bin) + 1)) AS INTEGER) AS bin FROM c GROUP BY channel) SELECT channel, bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (channel, bin)"""))
def a19(spark, d):
    return M.integer_histogram(M.entry_totals(L.parts(spark, d)), "total")


@query("a20_distribution", L.sql("parts", TOTALS + """, s AS (SELECT channel, count(*) AS n, avg(total) AS mean, median(total) AS median, stddev_samp(total) AS sd FROM totals GROUP BY 1)
  SELECT channel, n, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, round(mean - sd, 6) AS low, round(mean + sd, 6) AS high, round(1 / (sd * sqrt(2 * pi())), 6) AS curve_at_mean FROM s"""))
def a20(spark, d):
    return rounded(M.distribution(M.entry_totals(L.parts(spark, d)), "total"), "mean", "median", "sd", "low", "high", "curve_at_mean")


@query("a37_full_fraction_coverage", L.sql("points", """p AS (SELECT compound_id, channel, round(time, 2) AS t, count FROM points), w AS (SELECT channel, count(DISTINCT t) AS wanted FROM p GROUP BY 1),
  m AS (SELECT compound_id, channel, count(DISTINCT t) FILTER (count > 0) AS met FROM p GROUP BY 1, 2)
  SELECT channel, max(wanted) AS n_times, count(*) AS entries, count_if(met = wanted) AS "full", round(avg(CAST(met = wanted AS DOUBLE)), 6) AS share FROM m JOIN w USING (channel) GROUP BY 1"""))
def a37(spark, d):
    return rounded(M.full_fraction_coverage(L.points(spark, d)), "share")


@query("a39_scan_validation", L.sql("parts", "SELECT 'error' AS level, 'unknown channel Scaled' AS message UNION ALL SELECT 'warning', 'few entries' FROM (SELECT count(DISTINCT compound_id) AS n FROM parts) WHERE n / (SELECT count(*) FROM orders) < 0.5"))
def a39(spark, d):
    return M.scan_report(L.parts(spark, d), L.table(spark, d, "orders"), ["Count"])


@query("a39b_scan_of_another_source", L.sql("points parts", """nc AS (SELECT count(DISTINCT compound_id) AS c FROM points), ns AS (SELECT count(DISTINCT compound_id) AS n FROM parts)
  SELECT 'error' AS level, 'unknown channel ' || channel AS message FROM (SELECT DISTINCT channel FROM parts WHERE channel NOT IN ('Count'))
  UNION ALL SELECT 'warning', 'few entries' FROM ns, nc WHERE n / c < 0.5 UNION ALL SELECT 'warning', 'more entries than compounds' FROM ns, nc WHERE n / c > 1.05 UNION ALL SELECT 'warning', 'scan of parts, not of blocks'"""))
def a39_source(spark, d):
    compounds = L.library(spark, d).select("compound_id").distinct()
    return M.scan_report(L.parts(spark, d), compounds, ["Count"], source="parts", active="blocks")


@query("w01_fraction_index", L.sql("parts", FRACTIONS + " SELECT compound_id, channel, time, fraction, count FROM fr"))
def w01(spark, d):
    return M.with_fraction(L.parts(spark, d)).select("compound_id", "channel", "time", "fraction", "count")


@query("w06_last_wins", L.sql("sheet", "SELECT bb1, bb2, bb3, row_no, id FROM (SELECT *, row_number() OVER (PARTITION BY bb1, bb2, bb3 ORDER BY row_no DESC) AS n FROM sheet) WHERE n = 1"))
def w06(spark, d):
    from ..operators.parse import last_wins

    return last_wins(L.sheet(spark, d).select("bb1", "bb2", "bb3", "row_no", "id"), ["bb1", "bb2", "bb3"])


SPARSE = """ev AS (SELECT CAST(user_id AS VARCHAR) AS compound_id, event_type AS channel, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS time, count(*) AS count FROM events GROUP BY 1, 2, 3)"""


@query("a16_fraction_totals_sparse", f"WITH {SPARSE}, fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY compound_id, channel ORDER BY time) AS INTEGER) AS fraction FROM ev) SELECT channel, fraction, CAST(sum(count) AS DOUBLE) AS total, count(*) AS entries FROM fr GROUP BY 1, 2")
def a16_sparse(spark, d):
    ev = L.table(spark, d, "events")
    hour = ((F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600).cast("double")
    p = ev.groupBy(F.col("user_id").cast("string").alias("compound_id"), F.col("event_type").alias("channel"), hour.alias("time")).agg(F.count("*").cast("double").alias("count"))
    return M.fraction_totals(p)
