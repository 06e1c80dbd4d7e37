"""Queries of truncation checks and tree roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import joins as J
from ..operators import orders as R
from ..operators import parse as P
from ..operators import splittree as S
from ..operators import traces as T
from . import library as L
from .catalog import query
from .q_ingest import CLASS, NUM
from .q_traces import ALPHA, PEAKS_SQL

THR = 4.0
NULLS = "(bb1 = 'AgxNull' OR bb2 = 'AgxNull' OR bb3 = 'AgxNull')"
LIBRARY = f"""nl AS (SELECT *, {CLASS} AS c FROM rt_rows WHERE {NULLS}), anc AS (SELECT list(DISTINCT bb3) AS a FROM nl WHERE bb3 <> 'AgxNull'),
  tl AS (SELECT array_to_string(c, '-') AS key, rt AS t_rt FROM nl, anc WHERE len(c) BETWEEN 1 AND 2 AND len(list_distinct(c)) = len(c) AND len(list_filter(c, lambda x: NOT list_contains(a, x))) = 0)"""
VERIFIED = f"""{LIBRARY}, ab AS (SELECT DISTINCT bb1, bb2, bb3, rt, unnest([bb1, bb2, bb3, bb1 || '-' || bb2, bb1 || '-' || bb3, bb2 || '-' || bb3]) AS key FROM rt_rows),
  cf AS (SELECT ab.bb1, ab.bb2, ab.bb3, bool_or(abs(rt - t_rt) <= {THR}) AS conflict FROM ab JOIN tl USING (key) GROUP BY 1, 2, 3),
  vf AS (SELECT r.bb1, r.bb2, r.bb3, r.rt, NOT coalesce(conflict, false) AND NOT ({NULLS.replace("bb", "r.bb")} AND coalesce(abs(r.rt - (SELECT max(rt) FROM rt_rows WHERE len({CLASS}) = 0)) <= {THR}, false)) AS success
    FROM rt_rows r LEFT JOIN cf USING (bb1, bb2, bb3)),
  pd AS (SELECT * FROM vf WHERE NOT {NULLS})"""


def verified(spark, d):
    return S.verify(L.rt_rows(spark, d), THR)


def shown(key):
    return F.replace(key, F.lit(P.SEPARATOR), F.lit("-"))


@query("t20_truncation_library", L.sql("rt_rows", f"{LIBRARY} SELECT key, t_rt FROM tl"))
def t20(spark, d):
    return S.truncation_library(L.rt_rows(spark, d)).withColumn("key", shown(F.col("key")))


@query("j07_truncation_conflict", L.sql("rt_rows", f"{VERIFIED} SELECT r.bb1, r.bb2, r.bb3, coalesce(conflict, false) AS conflict FROM rt_rows r LEFT JOIN cf USING (bb1, bb2, bb3)"))
def j07(spark, d):
    rows = L.rt_rows(spark, d)
    return S.conflicts_ordered(rows, S.truncation_library(rows), THR)


MASK = " || '|' || ".join(f"CASE WHEN m & {1 << i} > 0 THEN 'AgxNull' ELSE bb{i + 1} END" for i in range(3))


@query("j08_positional_conflict", L.sql("rt_rows", f"""mk AS (SELECT bb1, bb2, bb3, rt, {MASK} AS key FROM rt_rows, range(1, 8) g(m)), mm AS (SELECT DISTINCT * FROM mk WHERE key <> bb1 || '|' || bb2 || '|' || bb3),
  h AS (SELECT mm.bb1, mm.bb2, mm.bb3, bool_or(abs(mm.rt - o.rt) <= {THR}) AS conflict FROM mm JOIN rt_rows o ON o.bb1 || '|' || o.bb2 || '|' || o.bb3 = key GROUP BY 1, 2, 3)
  SELECT r.bb1, r.bb2, r.bb3, coalesce(conflict, false) AS conflict FROM rt_rows r LEFT JOIN h USING (bb1, bb2, bb3)"""))
def j08(spark, d):
    return S.conflicts_positional(L.rt_rows(spark, d), THR)


@query("u03_library_union_rows", L.sql("rt_rows", f"{LIBRARY} SELECT key, t_rt FROM tl UNION ALL SELECT bb1 || '-' || bb2 || '-' || bb3, rt FROM rt_rows WHERE bb1 || '-' || bb2 || '-' || bb3 NOT IN (SELECT key FROM tl)"))
def u03(spark, d):
    rows = L.rt_rows(spark, d)
    return S.with_all_rows(S.truncation_library(rows), rows).withColumn("key", shown(F.col("key")))


@query("t21_sequence_verification", L.sql("rt_rows", f"{VERIFIED} SELECT * FROM vf"))
def t21(spark, d):
    return verified(spark, d)


@query("t22_tree_paths", L.sql("rt_rows", f"{VERIFIED} SELECT CAST(d AS INTEGER) AS depth, array_to_string([bb1, bb2, bb3][1:d], '|') AS prefix, max(CASE WHEN d = 3 THEN rt END) AS rt FROM pd, range(1, 4) g(d) WHERE success GROUP BY 1, 2"))
def t22(spark, d):
    return S.tree_paths(verified(spark, d))


@query("t23_split_tree", L.sql("rt_rows", f"{VERIFIED} SELECT count(*) AS n_rows, count_if(success) AS n_verified, (SELECT count(*) FROM pd) AS n_products, (SELECT count_if(success) FROM pd) AS n_products_verified FROM vf"))
def t23(spark, d):
    v = S.verify(S.canonical_rows(L.rt_rows(spark, d)), THR)
    full = ~S.has_null()
    return v.agg(F.count("*").alias("n_rows"), F.count_if("success").alias("n_verified"), F.count_if(full).alias("n_products"), F.count_if(full & F.col("success")).alias("n_products_verified"))


SHEET_RT = f"""sr AS (SELECT bb1, bb2, bb3, max_by(CAST(mass AS DOUBLE) * 60, row_no) AS rt FROM sheet WHERE regexp_matches(trim(mass), {NUM}) AND trim(variant) = 'cyclic' GROUP BY 1, 2, 3)"""
JOB = f"""{PEAKS_SQL}, {SHEET_RT}, pk AS (SELECT compound_id, max(rt) AS rt FROM peaks WHERE channel = 'Count' GROUP BY 1),
  pg AS (SELECT bb1, bb2, bb3, rt FROM rt_rows WHERE rt > 40),
  job AS (SELECT t.bb1, t.bb2, t.bb3, coalesce(sr.rt, pg.rt, pk.rt) AS rt, CASE WHEN sr.rt IS NOT NULL THEN 'metadata' WHEN pg.rt IS NOT NULL THEN 'pedigree' WHEN pk.rt IS NOT NULL THEN 'peak_pick' ELSE 'none' END AS rt_source
    FROM rt_rows t LEFT JOIN sr USING (bb1, bb2, bb3) LEFT JOIN pg USING (bb1, bb2, bb3) LEFT JOIN pk ON pk.compound_id = t.bb1 || '|' || t.bb2 || '|' || t.bb3),
  timed AS (SELECT * FROM job WHERE rt IS NOT NULL), {VERIFIED.replace("rt_rows", "timed")}"""


def job_times(spark, d):
    """Times of the library's tuples from the sheet, else from those the tuples' outcomes hold, else from their own peaks."""
    from ..sources import sheets
    from .q_ingest import folder

    tuples = L.rt_rows(spark, d)
    sheet = L.sheet(spark, d).where(F.trim("variant") == "cyclic")
    noted = P.in_unit(P.rt_value(F.col("mass")), P.rt_unit("mass (min)"), "seconds")
    noted = P.last_wins(sheet.select(*S.BBS, "row_no", noted.alias("rt")).where("rt is not null"), S.BBS)
    outcomes = tuples.select(S.key_of(S.positions()).alias("key"), "rt", F.lit(True).alias("passed"), F.col("row_no").alias("ord")).where("rt > 40")
    picks = T.direct_rt(T.pick(P.traces(L.points(spark, d).where("channel = 'Count'")), alpha=ALPHA))
    sources = {"metadata": noted, "pedigree": S.pedigree_rt(outcomes).select(*L.own_blocks("key", P.SEPARATOR), "rt"), "peak_pick": picks.select(*L.own_blocks(), "rt")}
    return sheets.stored_table(S.resolve_times(tuples.select("row_no", *S.BBS), sources), folder(spark))  # verification reads it often


@query("t23b_split_tree_rows", L.sql("sheet points rt_rows", f"{JOB} SELECT bb1, bb2, bb3, job.rt, rt_source, success FROM job LEFT JOIN vf USING (bb1, bb2, bb3)"))
def t23_rows(spark, d):
    times = job_times(spark, d)
    return times.drop("row_no").join(S.split_tree(times, THR).drop("rt"), S.BBS, "left")


@query("t23c_split_tree_paths", L.sql("sheet points rt_rows", f"{JOB} SELECT CAST(d AS INTEGER) AS depth, array_to_string([bb1, bb2, bb3][1:d], '|') AS prefix, max(CASE WHEN d = 3 THEN rt END) AS rt FROM pd, range(1, 4) g(d) WHERE success GROUP BY 1, 2"))
def t23_paths(spark, d):
    return S.tree_paths(S.split_tree(job_times(spark, d), THR))


@query("t23d_split_tree_audit", L.sql("sheet points rt_rows", f"""{JOB} SELECT 'n_rows' AS field, count(*) AS value FROM job UNION ALL SELECT 'n_' || s, (SELECT count(*) FROM job WHERE rt_source = s) FROM (VALUES ('metadata'), ('pedigree'), ('peak_pick'), ('none')) v(s)
  UNION ALL SELECT 'n_verified', count_if(success) FROM vf UNION ALL SELECT 'n_failed', count_if(NOT success) FROM vf"""))
def t23_audit(spark, d):
    times = job_times(spark, d)
    return S.audit(times, S.split_tree(times, THR))


@query("t24_metadata_rt_rows", L.sql("sheet", f"""p AS (SELECT bb1, bb2, bb3, row_no, CASE WHEN regexp_matches(trim(mass), {NUM}) THEN CAST(mass AS DOUBLE) * 60 END AS rt FROM sheet)
  SELECT bb1, bb2, bb3, rt FROM (SELECT *, row_number() OVER (PARTITION BY bb1, bb2, bb3 ORDER BY row_no DESC) AS n FROM p WHERE rt IS NOT NULL) WHERE n = 1"""))
def t24(spark, d):
    rt = P.in_unit(P.rt_value(F.col("mass")), P.rt_unit("mass (min)"), "seconds")
    rows = L.sheet(spark, d).select("bb1", "bb2", "bb3", "row_no", rt.alias("rt")).where("rt is not null")
    return P.last_wins(rows, S.BBS).select("bb1", "bb2", "bb3", "rt")


NAMES = "nm AS (SELECT DISTINCT trim(bb) AS name FROM (SELECT unnest([bb1, bb2, bb3]) AS bb FROM rt_rows) WHERE bb <> 'AgxNull')"


@query("a24_position_alphabet", L.sql("rt_rows", "x AS (SELECT 0 AS position, bb3 AS bb FROM rt_rows UNION SELECT 1, bb2 FROM rt_rows UNION SELECT 2, bb1 FROM rt_rows) SELECT position, array_to_string(list(bb ORDER BY bb), '|') AS blocks FROM x WHERE bb <> 'AgxNull' GROUP BY 1"))
def a24(spark, d):
    return S.alphabet(L.rt_rows(spark, d)).withColumn("blocks", F.array_join("blocks", "|"))


@query("a25_distinct_blocks", L.sql("rt_rows", f"{NAMES} SELECT name FROM nm"))
def a25(spark, d):
    return S.building_blocks(L.rt_rows(spark, d))


@query("a26_canonical_spelling", "SELECT lower(p_name) AS key, min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END) AS spelling FROM part GROUP BY 1")
def a26(spark, d):
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return K.canonical_names(L.table(spark, d, "part").select(spelled.alias("name")))


SUMMARY = f"""{VERIFIED}, gs AS (SELECT bb1, bb2, grouping_id(bb1, bb2) AS g, count(*) AS total, count_if(success) AS passed FROM pd GROUP BY GROUPING SETS ((bb1), (bb2), (bb1, bb2))),
  sm AS (SELECT CASE g WHEN 1 THEN 'cycle_1' WHEN 2 THEN 'cycle_2' ELSE 'cycle_1_and_2' END AS scope, bb1, bb2, total, passed, total - passed AS failed, round(100 * passed / total, 1) AS pass_pct, 100 * passed / total < 50 AS flagged
    FROM gs WHERE g <> 0 OR 100 * passed / total < 50)"""


@query("a27_pass_rate_summary", L.sql("rt_rows", f"{SUMMARY} SELECT * FROM sm"))
def a27(spark, d):
    return S.pass_summary(verified(spark, d))


@query("a28_library_pass_rate", L.sql("rt_rows", f"{VERIFIED} SELECT count(*) AS total, count_if(success) AS passed, round(100 * count_if(success) / count(*), 6) AS pass_pct FROM pd"))
def a28(spark, d):
    return S.library_pass(verified(spark, d)).withColumn("pass_pct", F.round("pass_pct", 6))


FLAGGED = f"""{SUMMARY}, lb AS (SELECT 100 * count_if(success) / count(*) AS lp FROM pd),
  fl AS (SELECT 1 AS cycle, s.bb1 AS bb, s.flagged, s.pass_pct, coalesce(p.n, 0) AS n, coalesce(p.l, '') AS couplings FROM sm s LEFT JOIN (SELECT bb1, count(*) AS n, string_agg(bb2, ';' ORDER BY bb2) AS l FROM sm WHERE scope = 'cycle_1_and_2' GROUP BY 1) p USING (bb1) WHERE scope = 'cycle_1'
    UNION ALL SELECT 2, s.bb2, s.flagged, s.pass_pct, coalesce(p.n, 0), coalesce(p.l, '') FROM sm s LEFT JOIN (SELECT bb2, count(*) AS n, string_agg(bb1, ';' ORDER BY bb1) AS l FROM sm WHERE scope = 'cycle_1_and_2' GROUP BY 1) p USING (bb2) WHERE scope = 'cycle_2'),
  ff AS (SELECT cycle, bb, CAST(flagged AS INTEGER) + CAST(n AS INTEGER) AS flags, couplings, pass_pct, round(pass_pct - lp, 1) AS delta, flagged FROM fl, lb WHERE CAST(flagged AS INTEGER) + n > 0)
  SELECT cycle, bb, flags, couplings, pass_pct, delta, concat_ws(' ', CASE WHEN flags > 1 THEN 'flagged ' || flags || ' times' END, CASE WHEN flagged THEN 'most products fail' END,
    CASE WHEN couplings <> '' THEN 'with ' || couplings END, CASE WHEN delta < -10 THEN 'below the library' WHEN delta > 10 THEN 'above the library' END) AS comment FROM ff"""


@query("a29_flagged_blocks", L.sql("rt_rows", FLAGGED))
def a29(spark, d):
    return S.flagged_blocks(verified(spark, d))


@query("o05_flagged_order", L.sql("rt_rows", FLAGGED.replace("SELECT cycle, bb, flags, couplings, pass_pct, delta, concat_ws", "SELECT cycle, bb, flags, pass_pct FROM ff ORDER BY flags DESC, pass_pct, cycle, bb LIMIT 5 --").split(" --")[0]))
def o05(spark, d):
    return S.flagged_order(S.flagged_blocks(verified(spark, d))).select("cycle", "bb", "flags", "pass_pct").limit(5)


@query("o05b_flagged_order_whole", L.sql("rt_rows", FLAGGED.rsplit("\n", 2)[0] + " SELECT cycle, bb, flags, pass_pct, row_number() OVER (ORDER BY flags DESC, pass_pct, cycle, bb) AS place FROM ff"))
def o05b(spark, d):
    from ..sources import sheets
    from .q_ingest import folder

    found = sheets.stored_table(S.flagged_blocks(verified(spark, d)).select("cycle", "bb", "flags", "pass_pct"), folder(spark))  # ranking reads it often
    return R.ranked(found, [-F.col("flags"), F.col("pass_pct"), F.col("cycle"), F.col("bb")])


SOURCES = "src AS (SELECT CASE WHEN row_no % 4 = 0 THEN 'metadata' WHEN row_no % 4 = 1 THEN 'pedigree' WHEN row_no % 4 = 2 THEN 'peak_pick' ELSE 'none' END AS s FROM rt_rows)"


@query("a30_run_audit", L.sql("rt_rows", f"""{VERIFIED}, {SOURCES} SELECT 'n_rows' AS field, count(*) AS value FROM src UNION ALL SELECT 'n_' || s, count(*) FROM src GROUP BY s
  UNION ALL SELECT 'n_verified', count_if(success) FROM vf UNION ALL SELECT 'n_failed', count_if(NOT success) FROM vf"""))
def a30(spark, d):
    rows = L.rt_rows(spark, d)
    m = F.col("row_no") % 4
    source = F.when(m == 0, "metadata").when(m == 1, "pedigree").when(m == 2, "peak_pick").otherwise("none")
    return S.audit(rows.withColumn("rt_source", source), verified(spark, d))


@query("a32_prefix_stats", L.sql("rt_rows", f"{VERIFIED} SELECT bb1, bb2, bb3, grouping_id(bb1, bb2, bb3) AS level, count(*) AS total, count_if(success) AS passed, 100 * count_if(success) / count(*) < 50 AS failed FROM pd GROUP BY ROLLUP (bb1, bb2, bb3)"))
def a32(spark, d):
    return S.prefix_stats(verified(spark, d), 50.0)


@query("a38_index_duplicates", "SELECT 'name' AS kind, lower(p_name) AS value, count(*) AS times FROM part GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'index', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2 HAVING count(*) > 1")
def a38(spark, d):
    return S.index_report(L.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("index")))


@query("t19_pedigree_rt_lookup", L.sql("rt_rows", """o AS (SELECT bb1 || '|' || bb2 AS key, rt, rt > 40 AS passed, row_no AS ord FROM rt_rows)
  SELECT key, coalesce(max_by(rt, ord) FILTER (passed), min_by(rt, ord)) AS rt FROM o GROUP BY 1"""))
def t19(spark, d):
    rows = L.rt_rows(spark, d)
    return S.pedigree_rt(rows.select(F.concat_ws("|", "bb1", "bb2").alias("key"), "rt", (F.col("rt") > 40).alias("passed"), F.col("row_no").alias("ord")))


@query("t25_global_index", L.sql("rt_rows", f"{NAMES}, o AS (SELECT name, row_number() OVER (ORDER BY lower(name), name) AS own FROM nm) SELECT name, CASE WHEN name = 'B3' THEN 77 ELSE own END AS index FROM o"))
def t25(spark, d):
    rows = L.rt_rows(spark, d)
    override = rows.where(F.col("bb1") == "B3").select(F.lower("bb1").alias("name"), F.lit(77).alias("index")).distinct()
    return S.global_index(S.building_blocks(rows), override)


@query("t26_cycle_index", L.sql("rt_rows", "x AS (SELECT 0 AS level, bb1 AS name FROM rt_rows UNION SELECT 1, bb2 FROM rt_rows UNION SELECT 2, bb3 FROM rt_rows) SELECT level, name, row_number() OVER (PARTITION BY level ORDER BY lower(name), name) AS index FROM x WHERE name <> 'AgxNull'"))
def t26(spark, d):
    return S.cycle_index(L.rt_rows(spark, d))


@query("j14_saturation_grid", L.sql("rt_rows", f"""{VERIFIED}, a AS (SELECT DISTINCT bb2 FROM vf WHERE bb2 <> 'AgxNull'), b AS (SELECT DISTINCT bb3 FROM vf WHERE bb3 <> 'AgxNull')
  SELECT a.bb2, b.bb3, coalesce(CASE WHEN success THEN 'PASS' WHEN NOT success THEN 'FAIL' END, '') AS mark FROM a CROSS JOIN b LEFT JOIN (SELECT * FROM vf WHERE bb1 = 'B2') v ON v.bb2 = a.bb2 AND v.bb3 = b.bb3"""))
def j14(spark, d):
    return J.saturation_grid(verified(spark, d), "B2")


@query("s14_products_sink", L.sql("rt_rows", f"{VERIFIED} SELECT bb1, bb2, bb3, rt, success AS rt_verified FROM pd"))
def s14(spark, d):
    from ..sources import sheets
    from .q_ingest import folder

    out = S.products(verified(spark, d)).select("bb1", "bb2", "bb3", "rt", F.col("success").alias("rt_verified"))
    return sheets.stored_table(out.sort("bb1", "bb2", "bb3"), folder(spark))


@query("s15_audit_sink", L.sql("rt_rows", f"{VERIFIED}, {SOURCES} SELECT 'n_rows' AS field, count(*) AS value FROM src UNION ALL SELECT 'n_' || s, count(*) FROM src GROUP BY s UNION ALL SELECT 'n_verified', count_if(success) FROM vf UNION ALL SELECT 'n_failed', count_if(NOT success) FROM vf"))
def s15(spark, d):
    from ..sources import sheets
    from .q_ingest import folder

    return sheets.stored_table(a30(spark, d), folder(spark))


@query("s16_summary_sink", L.sql("rt_rows", f"{SUMMARY} SELECT * FROM sm"))
def s16(spark, d):
    from ..sources import sheets
    from .q_ingest import folder

    return sheets.stored_table(a27(spark, d), folder(spark))
