"""Library metrics and plot data: grouped aggregates over points and signal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .orders import medians

#: Fixed value: fractions of a trace unless told otherwise.
FRACTIONS = 96


def channel_stats(df: DataFrame, value: Column | str, by: str = "channel") -> DataFrame:
    """by, mean, std_dev (sample; 0 for one value), n of what isn't null."""
    v = F.col(value) if isinstance(value, str) else value
    s = df.groupBy(by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_dev"), F.count(v).alias("n"))
    return s.select(by, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std_dev", F.lit(0.0)).alias("std_dev"), "n")


def entry_totals(points: DataFrame) -> DataFrame:
    return points.groupBy("compound_id", "channel").agg(F.sum(F.coalesce("count", F.lit(0.0))).alias("total"))


def entry_maxima(points: DataFrame) -> DataFrame:
    return points.groupBy("compound_id", "channel").agg(F.max("count").alias("max_count"))


def total_count_per_entry(points: DataFrame) -> DataFrame:
    return channel_stats(entry_totals(points), "total")


def avg_count_per_fraction(points: DataFrame, fractions: int = FRACTIONS) -> DataFrame:
    return channel_stats(entry_totals(points), F.col("total") / fractions)


def coverage_index(points: DataFrame, fractions: int = FRACTIONS) -> DataFrame:
    t = entry_totals(points).groupBy("channel").agg(F.sum("total").alias("s"), F.count("*").alias("n"))
    return t.select("channel", (F.col("s") / (F.col("n") * fractions)).alias("mean"), F.lit(0.0).alias("std_dev"), "n")


def with_fraction(points: DataFrame) -> DataFrame:
    """Points with their 1-based place in time; a missing count is 0."""
    w = W.partitionBy("compound_id", "channel").orderBy("time")
    return points.withColumn("fraction", F.row_number().over(w)).withColumn("count", F.coalesce("count", F.lit(0.0)))


def fraction_totals(points: DataFrame) -> DataFrame:
    f = with_fraction(points)
    return f.groupBy("channel", "fraction").agg(F.sum("count").alias("total"), F.count("*").alias("entries"))


def fraction_means(points: DataFrame) -> DataFrame:
    return with_fraction(points).groupBy("channel", "fraction").agg(F.avg("count").alias("mean_count"))


def mean_of_fraction_means(points: DataFrame) -> DataFrame:
    return channel_stats(fraction_means(points), "mean_count")


def histogram(df: DataFrame, value: str, bins: int = 50, by: str = "channel") -> DataFrame:
    """Equal bins from least to greatest value of each group, the last one closed; empty bins have 0. A group of one value
    is half a unit wide on both sides of it."""
    v = F.col(value)
    ends = df.where(v.isNotNull()).groupBy(by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    ends = ends.select(by, F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / width)).cast("int")
    counts = df.where(v.isNotNull()).join(ends, by).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = ends.select(by, "lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = all_bins.join(counts, [by, "bin"], "left")
    return out.select(by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def integer_histogram(df: DataFrame, value: str, by: str = "channel") -> DataFrame:
    """Bins one wide around 0, 1, ... up to the greatest value."""
    bin_ = F.floor(F.col(value) + 0.5).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    tops = counts.groupBy(by).agg(F.max("bin").alias("top"))
    all_bins = tops.select(by, F.explode(F.sequence(F.lit(0), "top")).alias("bin"))
    return all_bins.join(counts, [by, "bin"], "left").select(by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(df: DataFrame, value: str, by: str = "channel") -> DataFrame:
    """n, mean, median, SD, mean -/+ SD, and the normal curve's height at the mean. The median comes by narrowing, so no task
    holds a group's values."""
    v = F.col(value)
    s = df.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"))
    s = s.join(medians(df, value, by).withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    peak = F.when(F.col("sd") > 0, 1 / (F.col("sd") * F.sqrt(F.lit(2.0) * F.pi())))
    return s.select(by, "n", "mean", "median", "sd", (F.col("mean") - F.col("sd")).alias("low"), (F.col("mean") + F.col("sd")).alias("high"), peak.alias("curve_at_mean"))


def full_fraction_coverage(points: DataFrame, digits: int = 2) -> DataFrame:
    """Per channel, entries with a positive count at every consensus time (the union of rounded times), of all entries."""
    p = points.select("compound_id", "channel", F.round("time", digits).alias("t"), "count")
    wanted = p.groupBy("channel").agg(F.count_distinct("t").alias("wanted"))
    met = p.where("count > 0").groupBy("compound_id", "channel").agg(F.count_distinct("t").alias("met"))
    entries = p.select("compound_id", "channel").distinct()
    full = entries.join(met, ["compound_id", "channel"], "left").join(wanted, "channel")
    return full.groupBy("channel").agg(F.max("wanted").alias("n_times"), F.count("*").alias("entries"), F.count_if(F.col("met") == F.col("wanted")).alias("full"), F.avg((F.coalesce("met", F.lit(0)) == F.col("wanted")).cast("double")).alias("share"))


def scan_report(points: DataFrame, compounds: DataFrame, channels: list[str], source: str | None = None, active: str | None = None) -> DataFrame:
    """level, message rows: no entries or channels, or unknown channels, are errors; an odd share of compounds is a warning, and
    so is a scan of another source than the active one."""
    n = points.agg(F.count_distinct("compound_id").alias("entries"))
    m = compounds.agg(F.count("*").alias("compounds"))
    both = n.crossJoin(m)  # a row each
    share = F.col("entries") / F.greatest(F.col("compounds"), F.lit(1))
    messages = F.filter(
        F.array(
            F.when(F.col("entries") == 0, F.struct(F.lit("error").alias("level"), F.lit("no entries").alias("message"))),
            F.when((share < 0.5) & (F.col("entries") > 0), F.struct(F.lit("warning").alias("level"), F.lit("few entries").alias("message"))),
            F.when(share > 1.05, F.struct(F.lit("warning").alias("level"), F.lit("more entries than compounds").alias("message"))),
            F.when(F.lit(bool(source) and source != active), F.struct(F.lit("warning").alias("level"), F.lit(f"scan of {source}, not of {active}").alias("message"))),
        ),
        lambda x: x.isNotNull(),
    )
    known = points.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    unknown = points.select("channel").distinct().join(F.broadcast(known), "channel", "left_anti")
    return both.select(F.explode(messages).alias("m")).select("m.*").union(unknown.select(F.lit("error"), F.concat(F.lit("unknown channel "), "channel")))


#: Per-entry signal statistics that have a metric of their own: metric -> column of signal_stats.
SIGNAL_METRICS = {
    "baseline_mu_library": "baseline_mu",
    "baseline_sigma_library": "baseline_sigma",
    "tallest_significant_peak_height_mean": "tallest_peak_height",
    "tallest_significant_snr_excess_mean": "snr_excess",
    "tallest_significant_snr_ratio_mean": "snr_ratio",
    "tallest_significant_dynamic_range_mean": "dynamic_range",
    "fraction_with_significant_peak": "has_peak",
    "significant_peak_count_mean": "peak_count",
    "max_significant_prominence_mean": "max_prominence",
    "median_significant_prominence_mean": "median_prominence",
}


def signal_metric(stats: DataFrame, name: str) -> DataFrame:
    return channel_stats(stats, F.col(SIGNAL_METRICS[name]).cast("double"))
