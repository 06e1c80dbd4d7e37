"""Queries of joins and of the sinks that write their results (J, S08-S10, S17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import parse as P
from ..operators import splittree as S
from ..sources import sheets
from . import library as L
from .catalog import query
from .q_aggregates import rounded
from .q_ingest import NUM, folder, sheet_sql, stored
from .q_splittree import VERIFIED, verified
from .q_traces import PEAKS_SQL, STATS_SQL, library_peaks, library_stats


def part_compounds(spark, d):
    """compound_id of the volume library, with the sheet's variant and blocks."""
    return L.sheet(spark, d).select(F.concat(F.lit("P"), F.col("row_no").cast("string")).alias("compound_id"), "variant", "bb1", "bb2", "bb3")


@query("j01_traces_metadata", L.sql("parts sheet", "SELECT p.compound_id, channel, bb1, bb2, bb3, count(*) AS n_points FROM parts p JOIN sheet s ON p.compound_id = 'P' || s.row_no WHERE trim(variant) = 'linear' GROUP BY 1, 2, 3, 4, 5"))
def j01(spark, d):
    sizes = P.traces(L.parts(spark, d)).select("compound_id", "channel", F.size("rt").cast("long").alias("n_points"))  # traces stay where they lie
    return J.attach_positions(sizes, part_compounds(spark, d), ["linear"]).select("compound_id", "channel", "bb1", "bb2", "bb3", "n_points")


CASCADE = f"""pk AS (SELECT 'P' || l_partkey AS compound_id, max(((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)) AS rt FROM lineitem GROUP BY 1),
  ped AS (SELECT bb1 || '|' || bb2 || '|' || bb3 AS key, rt FROM rt_rows WHERE row_no % 3 <> 0),
  rs AS (SELECT 'P' || row_no AS compound_id, bb1 || '|' || bb2 || '|' || bb3 AS key, bb3 || '|' || bb2 || '|' || bb1 AS raw_key, CASE WHEN row_no % 4 = 0 AND regexp_matches(trim(mass), {NUM}) THEN CAST(mass AS DOUBLE) END AS meta_rt FROM sheet),
  rv AS (SELECT rs.compound_id, rs.key, coalesce(meta_rt, a.rt, b.rt, CASE WHEN CAST(substr(rs.compound_id, 2) AS INTEGER) % 2 = 1 THEN pk.rt END) AS assigned_rt, CASE WHEN meta_rt IS NOT NULL THEN 'metadata' WHEN coalesce(a.rt, b.rt) IS NOT NULL THEN 'pedigree'
     WHEN CAST(substr(rs.compound_id, 2) AS INTEGER) % 2 = 1 AND pk.rt IS NOT NULL THEN 'peak_pick' ELSE 'none' END AS rt_source
    FROM rs LEFT JOIN ped a ON a.key = rs.key LEFT JOIN ped b ON b.key = rs.raw_key LEFT JOIN pk ON pk.compound_id = rs.compound_id)"""


def resolved(spark, d):
    rows = L.sheet(spark, d)
    mass = F.when(F.col("row_no") % 4 == 0, P.rt_value(F.col("mass")))
    rows = rows.select(F.concat(F.lit("P"), F.col("row_no").cast("string")).alias("compound_id"), F.concat_ws("|", *S.BBS).alias("key"), F.concat_ws("|", *reversed(S.BBS)).alias("raw_key"), mass.alias("meta_rt"))
    ped = L.rt_rows(spark, d).where("row_no % 3 <> 0").select(F.concat_ws("|", *S.BBS).alias("key"), "rt")
    odd = F.substring("compound_id", 2, 20).cast("long") % 2 == 1
    picks = L.parts(spark, d).where(odd).groupBy("compound_id").agg(F.max("time").alias("rt"))
    return J.resolve_rt(rows, ped, picks)


@query("j05_rt_cascade", L.sql("sheet rt_rows", f"{CASCADE} SELECT rt_source, count(*) AS n, round(sum(assigned_rt), 3) AS total FROM rv GROUP BY 1"))
def j05(spark, d):
    return resolved(spark, d).groupBy("rt_source").agg(F.count("*").alias("n"), F.round(F.sum("assigned_rt"), 3).alias("total"))


@query("j06_assignment_table", L.sql("sheet rt_rows", f"{CASCADE} SELECT compound_id, key, assigned_rt, rt_source FROM rv"))
def j06(spark, d):
    return resolved(spark, d)


@query("j09_peak_assignment", L.sql("points rt_rows", f"""{PEAKS_SQL}, pk AS (SELECT compound_id, rt FROM peaks WHERE channel = 'Scaled'),
  asg AS (SELECT bb1 || '|' || bb2 || '|' || bb3 AS compound_id, rt + s AS a_rt, tier, 'tier ' || tier AS label FROM rt_rows, (VALUES (-2, 1), (0, 2), (2, 3)) t(s, tier)),
  c AS (SELECT p.compound_id, p.rt, min_by(label, {{'a': abs(p.rt - a_rt), 'b': -tier, 'c': label}}) AS label FROM pk p JOIN asg a USING (compound_id) WHERE abs(p.rt - a_rt) <= 4 GROUP BY 1, 2)
  SELECT p.compound_id, p.rt, coalesce(label, 'unknown') AS label FROM pk p LEFT JOIN c USING (compound_id, rt)"""))
def j09(spark, d):
    shifts = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(t).alias("tier")) for s, t in ((-2, 1), (0, 2), (2, 3)))))
    a = L.rt_rows(spark, d).select(F.concat_ws("|", *S.BBS).alias("compound_id"), "rt", shifts.alias("x"))
    a = a.select("compound_id", (F.col("rt") + F.col("x.s")).alias("a_rt"), "x.tier", F.concat(F.lit("tier "), F.col("x.tier").cast("string")).alias("label"))
    return J.nearest_assignment(library_peaks(spark, d).where("channel = 'Scaled'").select("compound_id", "rt"), a, 4.0)


@query("j10_node_compound", sheet_sql("""n AS (SELECT row_no AS node_id, CASE WHEN row_no % 3 = 0 THEN compound_id WHEN row_no % 3 = 1 THEN id ELSE bb1 || '-' || bb2 || '-' || bb3 || row_no END AS label FROM stored),
  k AS (SELECT compound_id, 0 AS rank, bb1 || '-' || bb2 || '-' || bb3 || row_no AS label FROM stored UNION ALL SELECT compound_id, 1, compound_id FROM stored UNION ALL SELECT compound_id, 2, id FROM stored)
  SELECT node_id, min_by(compound_id, {'a': rank, 'b': compound_id}) AS compound_id, min(rank) AS rank FROM n JOIN k USING (label) GROUP BY 1""").replace("WHERE n = 1)\nn AS", "WHERE n = 1),\nn AS"))
def j10(spark, d):
    c = stored(spark, d).withColumn("shown", F.concat(F.concat_ws("-", *S.BBS), F.col("row_no").cast("string")))
    kind = F.col("row_no") % 3
    nodes = c.select(F.col("row_no").alias("node_id"), F.when(kind == 0, F.col("compound_id")).when(kind == 1, F.col("id")).otherwise(F.col("shown")).alias("label"))
    return J.match_by_keys(nodes, c, ["shown", "compound_id", "id"])


ASSIGNED = "(SELECT 'C' || (row_no % 1000) AS id, max(rt) AS assigned_rt FROM rt_rows WHERE row_no % 2 = 0 GROUP BY 1)"


@query("j11_sheet_assignments", L.sql("sheet rt_rows", f"SELECT s.row_no, s.id, assigned_rt FROM sheet s LEFT JOIN {ASSIGNED} a ON a.id = s.id"))
def j11(spark, d):
    a = L.rt_rows(spark, d).where("row_no % 2 = 0").groupBy(F.concat(F.lit("C"), (F.col("row_no") % 1000).cast("string")).alias("id")).agg(F.max("rt").alias("assigned_rt"))
    return L.sheet(spark, d).join(a, "id", "left").select("row_no", "id", "assigned_rt")


@query("j12_index_differences", """WITH a AS (SELECT lower(p_name) AS name, count(*) AS times FROM part WHERE p_size > 10 GROUP BY 1), b AS (SELECT DISTINCT lower(upper(p_name)) AS name FROM part WHERE p_size < 30)
  SELECT name, CASE WHEN times IS NULL THEN 'extra' WHEN b.name IS NULL THEN 'missing' ELSE 'both' END AS state, coalesce(times, 0) > 1 AS repeated FROM a FULL JOIN b USING (name)""")
def j12(spark, d):
    parts = L.table(spark, d, "part")
    return J.name_differences(parts.where("p_size > 10").select(F.col("p_name").alias("name")), parts.where("p_size < 30").select(F.upper("p_name").alias("name")))


@query("j13_display_index", L.sql("rt_rows", "SELECT row_no, bb1, CASE bb1 WHEN 'AgxNull' THEN 0 WHEN 'B1' THEN 11 WHEN 'B2' THEN 12 WHEN 'B3' THEN 13 END AS idx FROM rt_rows"))
def j13(spark, d):
    rows = L.rt_rows(spark, d)
    index = rows.where(F.col("bb1").isin("B1", "B2", "B3")).select(F.when(F.col("bb1") == "B2", F.lower("bb1")).otherwise(F.col("bb1")).alias("name"), (F.substring("bb1", 2, 9).cast("int") + 10).alias("index")).distinct()
    return J.display_index(rows.select("row_no", "bb1"), "bb1", index).select("row_no", "bb1", "idx")


@query("j16_isoform_delta", L.sql("sheet", f"""r AS (SELECT id AS name, trim(variant) AS v, CASE WHEN regexp_matches(trim(mass), {NUM}) THEN CAST(mass AS DOUBLE) END AS rt FROM sheet WHERE id IS NOT NULL)
  SELECT name, max(rt) FILTER (v = 'linear') AS linear, max(rt) FILTER (v = 'cyclic') AS cyclic, max(rt) FILTER (v = 'cyclic') - max(rt) FILTER (v = 'linear') AS delta FROM r GROUP BY 1"""))
def j16(spark, d):
    rows = L.sheet(spark, d).where("id is not null").select(F.col("id").alias("name"), "variant", P.rt_value(F.col("mass")).alias("rt"))
    return J.isoform_delta(rows, "linear", "cyclic")


@query("j17_verification_assignments", L.sql("rt_rows", f"{VERIFIED} SELECT r.row_no, r.rt, CASE WHEN pd.bb1 IS NOT NULL THEN pd.success END AS null_rt_verified FROM rt_rows r LEFT JOIN pd USING (bb1, bb2, bb3)"))
def j17(spark, d):
    v = S.products(verified(spark, d)).select(*S.BBS, F.col("success").alias("null_rt_verified"))
    return L.rt_rows(spark, d).join(v, S.BBS, "left").select("row_no", "rt", "null_rt_verified")


@query("j18_verdict_products", L.sql("rt_rows", f"{VERIFIED}, w AS (SELECT pd.*, r.row_no % 2 = 0 AS pedigree_passed FROM pd JOIN rt_rows r USING (bb1, bb2, bb3)) SELECT count(*) AS n_products, count_if(pedigree_passed) AS n_pedigree, count_if(success = pedigree_passed) AS n_agree FROM w"))
def j18(spark, d):
    verdict = L.rt_rows(spark, d).select(*S.BBS, (F.col("row_no") % 2 == 0).alias("pedigree_passed"))
    both = S.products(verified(spark, d)).join(verdict, S.BBS, "left")
    return both.agg(F.count("*").alias("n_products"), F.count_if("pedigree_passed").alias("n_pedigree"), J.agree(F.col("success"), F.col("pedigree_passed")).alias("n_agree"))


METRIC_ROWS = "SELECT '{0}' AS metric_id, channel, round(avg(CAST({1} AS DOUBLE)), 6) AS mean, round(coalesce(stddev_samp(CAST({1} AS DOUBLE)), 0), 6) AS std_dev, count({1}) AS n FROM stats GROUP BY 2"


@query("s08_metrics_sink", L.sql("points", STATS_SQL + "\n" + " UNION ALL ".join(METRIC_ROWS.format(*x) for x in M.SIGNAL_METRICS.items())))
def s08(spark, d):
    stats = sheets.stored_table(library_stats(spark, d), folder(spark))
    out = None
    for name in M.SIGNAL_METRICS:
        one = rounded(M.signal_metric(stats, name), "mean", "std_dev").select(F.lit(name).alias("metric_id"), "channel", "mean", "std_dev", "n")
        out = one if out is None else out.union(one)
    return sheets.stored_table(out, folder(spark))


@query("s09_signal_sink", L.sql("points", f"{STATS_SQL} SELECT compound_id, channel, peak_count, tallest_peak_height, round(snr_excess, 6) AS snr_excess FROM stats"))
def s09(spark, d):
    written = sheets.stored_table(library_stats(spark, d), folder(spark))
    return written.select("compound_id", "channel", "peak_count", "tallest_peak_height", F.round("snr_excess", 6).alias("snr_excess"))


@query("s10_peak_sink", L.sql("points", f"{PEAKS_SQL} SELECT compound_id, channel, peak, rt AS retention_time, intensity AS max_intensity, area, round(pct_area, 4) AS pct_area, left_rt, right_rt FROM peaks"))
def s10(spark, d):
    p = library_peaks(spark, d).select("compound_id", "channel", "peak", F.col("rt").alias("retention_time"), F.col("intensity").alias("max_intensity"), "area", F.round("pct_area", 4).alias("pct_area"), "left_rt", "right_rt")
    return sheets.stored_table(p, folder(spark))


@query("s17_annotated_sheet", L.sql("rt_rows", f"{VERIFIED} SELECT CAST(r.row_no AS VARCHAR) AS row_no, CAST(r.rt AS VARCHAR) AS \"assigned_rt (s)\", 'pedigree' AS rt_source, CASE WHEN pd.bb1 IS NULL THEN NULL WHEN pd.success THEN 'TRUE' ELSE 'FALSE' END AS null_rt_verified, '{4.0}' AS threshold FROM rt_rows r LEFT JOIN pd USING (bb1, bb2, bb3)"))
def s17(spark, d):
    out = j17(spark, d).select(F.col("row_no").cast("string").alias("row_no"), F.col("rt").cast("string").alias(K.rt_header("assigned_rt", "seconds")), F.lit("pedigree").alias("rt_source"), F.when(F.col("null_rt_verified"), "TRUE").when(~F.col("null_rt_verified"), "FALSE").alias("null_rt_verified"), F.lit("4.0").alias("threshold"))
    path = folder(spark)
    sheets.write_csv(out, path)
    return sheets.read_sheet(spark, path)
