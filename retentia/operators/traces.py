"""Operators on traces: peaks, baselines, signal statistics. Numerical kernels run on Arrow batches of whole traces, all traces
of a batch side by side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ragged as R
from ..functions import signal as G

PEAKS = "compound_id string, channel string, peak int, rt double, intensity double, area double, prominence double, p_value double, pct_area double, left_rt double, right_rt double"
ANALYSED = PEAKS + ", baseline_mu double, baseline_sigma double, dispersion double"
BASELINES = "compound_id string, channel string, baseline_mu double, baseline_sigma double, dispersion double"


def arrays(batch: pa.RecordBatch):
    """(row, rt, y) of each trace of a batch."""
    rt, y = batch.column("rt"), batch.column("y")
    for i in range(batch.num_rows):
        yield i, rt[i].values.to_numpy(zero_copy_only=False).astype(float), y[i].values.to_numpy(zero_copy_only=False).astype(float)


def flat(batch: pa.RecordBatch):
    """(range of rows, rt, y, offsets) of the traces of a batch, some at a time."""
    size = pc.fill_null(pc.list_value_length(batch.column("rt")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    every = np.append(0, np.cumsum(size))
    rt, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("rt", "y"))
    for i, j in R.chunks(every):
        part = slice(every[i], every[j])
        yield i, j, rt[part], y[part], every[i : j + 1] - every[i]


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    """Columns by a schema's order: Arrow arrays, or numpy arrays in which NaN stands for null."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    made = [c if isinstance(c, pa.Array) else pa.array(c, kinds[k], from_pandas=True) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(made, [n for n, _ in fields])


def rows_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def picker(kind: str = "modern", alpha: float = 0.001, options: G.GaussianOptions | None = None):
    """A function from many traces to their peaks."""
    if kind == "modern":
        return lambda traces: R.pick_lists(traces, alpha)
    return lambda traces: R.pick_gaussian_lists(traces, options or G.GaussianOptions())


def pick(traces: DataFrame, kind: str = "modern", alpha: float = 0.001, options: G.GaussianOptions | None = None, min_prominence: float = 0.0, min_pct_area: float = 0.0) -> DataFrame:
    """The peaks of every trace of three points or more, numbered in order of time, with each one's share of the area of all
    that were found; then only those of enough prominence and share."""
    return _picked(traces, _found(kind, alpha, options), min_prominence, min_pct_area, PEAKS)


def analyse(traces: DataFrame, kind: str = "modern", alpha: float = 0.001, options: G.GaussianOptions | None = None, min_prominence: float = 0.0, min_pct_area: float = 0.0) -> DataFrame:
    """The peaks of pick, each with its trace's baseline, in one pass over the traces. What can't be analysed: failures."""
    return _picked(traces, _found(kind, alpha, options), min_prominence, min_pct_area, ANALYSED)


def _found(kind: str, alpha: float, options: G.GaussianOptions | None):
    """A function from many traces, one after another, to their peaks and the peaks' times."""
    if kind != "modern":
        return lambda rt, y, off: R.pick_gaussian(rt, y, off, options or G.GaussianOptions())

    def modern(rt, y, off):
        p = R.pick(y, off, alpha)
        return p, rt[p.apex]

    return modern


def _picked(traces: DataFrame, find, min_prominence: float, min_pct_area: float, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, channels = batch.column("compound_id"), batch.column("channel")
            for i, _, rt, y, off in flat(batch):
                p, at = find(rt, y, off)
                pct, good = p.share(), p.of_quality(min_prominence, min_pct_area)
                p, at, pct = p.where(good), at[good], pct[good]
                number = np.arange(1, len(pct) + 1) - np.searchsorted(p.trace, p.trace)
                row = pa.array(i + p.trace)
                more = (x[p.trace] for x in R.clipped(y, off)) if schema == ANALYSED else ()
                yield batch_of(schema, ids.take(row), channels.take(row), number, at, y[p.apex], p.area, p.prominence, p.p_value, pct, rt[p.left], rt[p.right], *more)

    return traces.where(F.size("rt") >= 3).select("compound_id", "channel", "rt", "y").mapInArrow(run, schema)


def failures(traces: DataFrame) -> DataFrame:
    """Traces that can't be analysed, with the reason."""
    return traces.where(F.size("rt") < 3).select("compound_id", "channel", F.lit("fewer than 3 points").alias("error"))


def baselines(traces: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j, _, y, off in flat(batch):
                yield batch_of(BASELINES, batch.column("compound_id").slice(i, j - i), batch.column("channel").slice(i, j - i), *R.clipped(y, off))

    return traces.select("compound_id", "channel", "rt", "y").mapInArrow(run, BASELINES)


def maxima(points: DataFrame) -> DataFrame:
    """Points that start a plateau higher than what stands on both sides, with the plateau's neighbours, by windows alone:
    runs of equal counts are islands, compared with the one before and the one after."""
    w = W.partitionBy("compound_id", "channel").orderBy("time")
    before = F.lag("count").over(w)
    starts = points.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("count")))
    after = F.lead("count").over(w)
    return starts.withColumn("after", after).where("before < count and after < count").select("compound_id", "channel", "time", "count")


def valleys(points: DataFrame) -> DataFrame:
    """For every point, the times to which counts fall strictly from it on both sides."""
    w = W.partitionBy("compound_id", "channel").orderBy("time")
    left, right = F.lag("count").over(w), F.lead("count").over(w)
    marked = points.withColumn("stop_left", F.when(left.isNull() | (left >= F.col("count")), F.col("time"))).withColumn("stop_right", F.when(right.isNull() | (right >= F.col("count")), F.col("time")))
    back, on = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    return marked.select("compound_id", "channel", "time", "count", F.last("stop_left", True).over(back).alias("left_rt"), F.first("stop_right", True).over(on).alias("right_rt"))


APEXES = "compound_id string, channel string, rt double, prominence double, local_mu double, local_sigma double, local_r double"


def apexes(traces: DataFrame) -> DataFrame:
    """Prominence and local baseline of every local maximum."""

    def run(batches):
        for batch in batches:
            for i, _, rt, y, off in flat(batch):
                a = R.local_maxima(y, off)
                row = pa.array(i + R.lanes(off)[a])
                around = R.local_baselines(y, off, a, *R.valley_bounds(y, off, a))
                yield batch_of(APEXES, batch.column("compound_id").take(row), batch.column("channel").take(row), rt[a], R.prominence(y, off, a), *around)

    return traces.select("compound_id", "channel", "rt", "y").mapInArrow(run, APEXES)


def nearest_sample(traces: DataFrame, target: float) -> DataFrame:
    """Place (from 0) and time of the sample nearest to a time, the first on ties."""
    at = F.posexplode("rt").alias("place", "t")
    p = traces.select("compound_id", "channel", at)
    best = F.min_by(F.struct("place", "t"), F.struct(F.abs(F.col("t") - target), F.col("place"))).alias("b")
    return p.groupBy("compound_id", "channel").agg(best).select("compound_id", "channel", F.col("b.place").alias("place"), F.col("b.t").alias("time"))


MEASURED = "compound_id string, channel string, baseline_mu double, baseline_sigma double, first_rt double, peak_count long, max_prominence double, median_prominence double, height double, tall_rt double"


def measured(batches, alpha: float):
    """Of each trace its baseline, and of its peaks number, prominences and the tallest (the earliest on ties)."""
    for batch in batches:
        for i, j, rt, y, off in flat(batch):
            n, p = j - i, R.pick(y, off, alpha)
            mu, sigma, _ = R.clipped(y, off)
            count = np.bincount(p.trace, minlength=n)
            some, first = np.flatnonzero(count), np.cumsum(count) - count
            most, middle, height, tall = (np.full(n, np.nan) for _ in range(4))
            by_prominence = p.prominence[np.lexsort((p.prominence, p.trace))]
            low, high = by_prominence[(first + (count - 1) // 2)[some]], by_prominence[(first + count // 2)[some]]
            most[some], middle[some] = by_prominence[(first + count - 1)[some]], (low + high) / 2
            tallest = np.lexsort((rt[p.apex], -y[p.apex], p.trace))[first[some]]
            height[some], tall[some] = y[p.apex[tallest]], rt[p.apex[tallest]]
            yield batch_of(MEASURED, batch.column("compound_id").slice(i, n), batch.column("channel").slice(i, n), mu, sigma, rt[off[:-1]], count, most, middle, height, tall)


def signal_stats(traces: DataFrame, alpha: float = 0.001) -> DataFrame:
    """Per trace of three points or more: baseline, peak count, prominences, and the tallest peak against the baseline, in one
    pass over the traces."""
    keys = ["compound_id", "channel"]
    out = traces.where(F.size("rt") >= 3).select(*keys, "rt", "y").mapInArrow(lambda batches: measured(batches, alpha), MEASURED)
    height = F.coalesce("height", F.lit(0.0))
    excess = height - F.col("baseline_mu")
    return out.select(
        *keys,
        "baseline_mu",
        "baseline_sigma",
        "peak_count",
        (F.col("peak_count") > 0).alias("has_peak"),
        F.coalesce("max_prominence", F.lit(0.0)).alias("max_prominence"),
        "median_prominence",
        height.alias("tallest_peak_height"),
        F.coalesce("tall_rt", "first_rt").alias("tallest_peak_rt"),
        excess.alias("snr_excess"),
        F.when(F.col("baseline_sigma") > 1e-12, excess / F.col("baseline_sigma")).alias("snr_ratio"),
        F.when(F.col("baseline_mu") > 1e-12, height / F.col("baseline_mu")).alias("dynamic_range"),
    )


def direct_rt(peaks: DataFrame, maxima_: DataFrame | None = None, minimum_rt: float = 0.0, factor: float = 0.0) -> DataFrame:
    """A compound's retention time from its own trace: its latest peak; in the old way only peaks late and high enough."""
    if maxima_ is not None:
        peaks = peaks.join(maxima_, ["compound_id", "channel"]).where((F.col("rt") >= minimum_rt) & (F.col("intensity") >= factor * F.col("max_count")))
    return peaks.groupBy("compound_id", "channel").agg(F.max("rt").alias("rt"))


def peak_picks(peaks: DataFrame, floor: float) -> DataFrame:
    """Of each trace's peaks past a floor, the earliest and the most significant."""
    past = peaks.where(F.col("rt") > floor)
    return past.groupBy("compound_id", "channel").agg(F.min("rt").alias("earliest"), F.min_by("rt", F.struct("p_value", "rt")).alias("most_significant"))


def prominence_at(traces: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: compound_id, chosen_rt. The prominence at each trace's sample nearest to it, for traces of 3 points or more."""
    kind = "compound_id string, channel string, chosen_rt double, prominence double"

    def run(batches):
        for batch in batches:
            ids, channels, chosen = (batch.column(c).to_pylist() for c in ("compound_id", "channel", "chosen_rt"))
            yield rows_batch([(ids[i], channels[i], chosen[i], G.prominence(y, int(np.abs(rt - chosen[i]).argmin()))) for i, rt, y in arrays(batch)], kind)

    return traces.where(F.size("rt") >= 3).join(wanted, "compound_id").select("compound_id", "channel", "chosen_rt", "rt", "y").mapInArrow(run, kind)
