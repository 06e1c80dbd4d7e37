"""Queries of the pedigree and of lineages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import parse as P
from ..operators import pedigree as D
from ..operators import splittree as S
from ..operators import traces as T
from ..sources import sheets
from . import library as L
from .catalog import query
from .q_aggregates import rounded
from .q_ingest import folder
from . import pedigree_sql as Q
from .q_splittree import THR, VERIFIED
from .q_traces import ALPHA as PICK_ALPHA
from .q_traces import BASE_SQL, OLD, PEAKS_SQL, TR, old_peaks_sql

TOLERANCE, ALPHA = 1.0, 0.001


find_many = T.picker("modern", ALPHA)


def members(spark, d):
    return D.members(L.rt_rows(spark, d))


def node_traces(spark, d):
    """key (positions N to C), rt, y of the Count channel, with a signal laid over it: the more blocks, the later. Some
    blocks have none, and some come before their parents, so that classes fail and their children are pruned."""
    pts = L.points(spark, d).where("channel = 'Count'")
    blocks = F.filter(F.split("compound_id", r"\|"), lambda x: x != L.NULL)
    pts = pts.withColumn("n", F.size(blocks)).withColumn("w", F.aggregate(F.transform(blocks, lambda x: F.substring(x, 2, 9).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x))
    n, w = F.col("n"), F.col("w")
    center = F.when((n == 0) | (w % 5 != 4), 6 + 18 * n + 2 * (w % 8) - F.when((n > 1) & (w % 7 == 6), 36).otherwise(0))
    away = F.abs(F.col("time") - center)
    tr = P.traces(pts.withColumn("count", F.col("count") * F.when(away == 0, 30).when(away == 1, 12).otherwise(1)))
    key = F.array_join(F.reverse(F.split("compound_id", r"\|")), "|")
    return tr.select(key.alias("key"), "rt", "y")


def tuples(spark, d):
    """bb1..bb3 of the library's tuples, stored: alphabets, members and lineages read them, and what these ask of a tuple would
    else be asked of every row of `lineitem`."""
    return sheets.stored_table(L.rt_rows(spark, d).select(*S.BBS), folder(spark))


def evaluated(spark, d, find=find_many, rows=None):
    """members (spelt out only where they are read), outcomes of the library's pedigree. rows: its tuples, where they are at hand."""
    rows = tuples(spark, d) if rows is None else rows
    return D.members(rows), D.evaluate_library(rows, node_traces(spark, d), TOLERANCE, find, ALPHA)


def shown(outcomes, scale=1):
    """Outcomes as plain columns: rounded numbers, and lists as text."""
    number = lambda c, x: (F.round(x * scale) if scale > 1 and c in Q.LISTS else x).cast("int").cast("string")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(number(c, x), F.lit("-"))), " ").alias(c)
    lists = [*Q.LISTS, "bayesian_supporting_replicates", "replicates_with_no_signal"]
    total = F.aggregate(F.filter("per_rep_score_contribution", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return outcomes.select(
        "node_id", "passed", "insufficient_data", *(F.round(c, 5).alias(c) for c in Q.NUMBERS), *(text(c) for c in lists),
        F.when(F.size("per_rep_score_contribution") > 0, F.round(total, 4)).alias("score_contribution"), "n_replicates", "n_replicates_with_signal",
    )


MEMBERS = """al AS (SELECT DISTINCT 0 AS i, bb3 AS b FROM rt_rows UNION SELECT 1, bb2 FROM rt_rows UNION SELECT 2, bb1 FROM rt_rows),
  ra AS (SELECT i, b, CASE WHEN b = 'AgxNull' THEN 1000000 ELSE row_number() OVER (PARTITION BY i ORDER BY b = 'AgxNull', b) END AS r FROM al),
  cells AS (SELECT x.b AS p0, y.b AS p1, z.b AS p2, x.r AS r0, y.r AS r1, z.r AS r2, list_filter([x.b, y.b, z.b], lambda q: q <> 'AgxNull') AS c FROM ra x, ra y, ra z WHERE x.i = 0 AND y.i = 1 AND z.i = 2),
  mb AS (SELECT CASE WHEN len(c) = 3 THEN 'F3_' || array_to_string(c, '_') WHEN len(c) = 0 THEN 'C0' ELSE 'C' || len(c) || '_' || array_to_string(c, '_') END AS node_id, CASE WHEN len(c) = 3 THEN 'compound' ELSE 'class' END AS kind,
    CAST(len(c) AS INTEGER) AS tier, c, p0 || '|' || p1 || '|' || p2 AS key, r0, r1, r2 FROM cells),
  members AS (SELECT node_id, kind, tier, c, key, CAST(row_number() OVER (PARTITION BY node_id ORDER BY r0, r1, r2) - 1 AS INTEGER) AS ord FROM mb),
  nodes AS (SELECT node_id, kind, tier, c FROM members WHERE ord = 0),
  up AS (SELECT node_id AS child_id, unnest(list_transform(range(len(c)), lambda i: array_to_string(c[:i] || c[i + 2 :], '_'))) AS pk FROM nodes WHERE tier > 0),
  edges AS (SELECT DISTINCT n.node_id AS parent_id, child_id FROM up JOIN nodes n ON n.kind = 'class' AND array_to_string(n.c, '_') = pk)"""


@query("t07_pedigree_nodes", L.sql("rt_rows", f"{MEMBERS} SELECT node_id, kind, tier, key, ord FROM members"))
def t07(spark, d):
    return members(spark, d).select("node_id", "kind", "tier", "key", "ord")


@query("t08_pedigree_edges", L.sql("rt_rows", f"{MEMBERS} SELECT * FROM edges"))
def t08(spark, d):
    return D.edges(D.nodes(members(spark, d)))


@query("j02_members_traces", L.sql("rt_rows points", f"{MEMBERS}, tr AS (SELECT array_to_string(list_reverse(string_split(compound_id, '|')), '|') AS key, count(*) AS n FROM points WHERE channel = 'Count' GROUP BY 1) SELECT node_id, ord, coalesce(n, 0) AS n_points FROM members LEFT JOIN tr USING (key)"))
def j02(spark, d):
    return D.replicates(members(spark, d), node_traces(spark, d)).select("node_id", "ord", F.size("rt").cast("long").alias("n_points"))


MADE = "oc AS (SELECT node_id, max(rt) > 25 AS passed, CASE WHEN min(rt) > 3 THEN min(rt) END AS chosen_rt FROM members JOIN rt_rows ON bb3 || '|' || bb2 || '|' || bb1 = key GROUP BY 1)"


def simple_outcomes(spark, d):
    """Stand-in outcomes from the rows' times, so that gates can be held against SQL."""
    key = F.concat_ws("|", "bb3", "bb2", "bb1").alias("key")
    m = members(spark, d).join(L.rt_rows(spark, d).select(key, "rt"), "key")
    return m.groupBy("node_id").agg((F.max("rt") > 25).alias("passed"), F.when(F.min("rt") > 3, F.min("rt")).alias("chosen_rt"))


@query("j03_parent_gate", L.sql("rt_rows", f"{MEMBERS}, {MADE} SELECT child_id AS node_id, max(chosen_rt) AS threshold FROM edges LEFT JOIN oc ON node_id = parent_id GROUP BY 1 HAVING bool_and(coalesce(passed AND chosen_rt IS NOT NULL, false))"))
def j03(spark, d):
    return J.parent_gate(D.edges(D.nodes(members(spark, d))), simple_outcomes(spark, d))


@query("j04_cassette_threshold", L.sql("rt_rows", f"""{MEMBERS}, {MADE}, g AS (SELECT child_id AS node_id, max(chosen_rt) AS threshold FROM edges LEFT JOIN oc ON node_id = parent_id GROUP BY 1),
  s AS (SELECT c[1] AS component, chosen_rt AS rt FROM nodes JOIN oc USING (node_id) WHERE tier = 1 AND passed), k AS (SELECT node_id, unnest(c) AS bb FROM nodes WHERE kind = 'class'),
  m AS (SELECT node_id, max(rt) AS least FROM k JOIN s ON component IN ('B1', 'B2') WHERE bb = 'B3' GROUP BY 1) SELECT node_id, CASE WHEN least > threshold OR threshold IS NULL THEN least ELSE threshold END AS threshold FROM g LEFT JOIN m USING (node_id)"""))
def j04(spark, d):
    n = D.nodes(members(spark, d))
    o = simple_outcomes(spark, d)
    gate = D.edges(n).join(o.withColumnRenamed("node_id", "parent_id"), "parent_id", "left").groupBy(F.col("child_id").alias("node_id")).agg(F.max("chosen_rt").alias("threshold"))
    singles = n.where("tier = 1").join(o.where("passed"), "node_id").select(F.col("class")[0].alias("component"), F.col("chosen_rt").alias("rt"))
    named = n.where("kind = 'class'").withColumn("class", F.transform("class", lambda x: F.when(x == "B3", "B1-B2").otherwise(x)))
    return J.raise_for_cassettes(gate, named, singles)


CLS = "split_part(p.compound_id, '|', 1)"


@query("t09_joint_score", L.sql("points", f"""{TR}, {BASE_SQL}, q AS (SELECT {CLS} AS cls, time, count, greatest(mu, 0.5) AS m, greatest(mu, 0.5) + greatest(mu, 0.5) * greatest(mu, 0.5) / coalesce(r, 1e6) AS v
    FROM points p JOIN bl ON bl.compound_id = p.compound_id AND bl.channel = p.channel WHERE p.channel = 'Count'),
  g AS (SELECT cls, time, count, m, v, unnest(range(CAST(ceil(time - 4) AS BIGINT), CAST(floor(time + 4) AS BIGINT) + 1)) AS a FROM q)
  SELECT cls, CAST(a AS INTEGER) AS at, round(sum(exp(-pow(time - a, 2) / 2) * (count - m) / v), 6) AS u, round(sum(exp(-pow(time - a, 2)) / v), 6) AS info FROM g GROUP BY 1, 2"""))
def t09(spark, d):
    pts = L.points(spark, d).where("channel = 'Count'")
    base = T.baselines(P.traces(pts)).select("compound_id", F.col("baseline_mu").alias("mu"), F.col("dispersion").alias("r"))
    named = pts.join(base, "compound_id").withColumn("cls", F.split("compound_id", r"\|")[0])
    return rounded(D.joint_scores(named, TOLERANCE), "u", "info")


FIT = f"""{Q.base_sql(ALPHA)}, named AS (SELECT split_part(key, '|', 3) AS node_id, * FROM nt), cp0 AS (SELECT node_id, m, v, unnest(rt) AS t, unnest(y) AS yy FROM named), cp AS MATERIALIZED (SELECT node_id, t, (yy - m) / v AS a, 1 / v AS b FROM cp0),
  cw AS (SELECT node_id, 5.0 AS low, max(rt[-1]) AS high, greatest(least(coalesce(min(abs(rt[2] - rt[1]) / 2) FILTER (len(rt) > 1), 0.1), 0.1), 0.01) AS step, count(*) AS n FROM named GROUP BY 1 HAVING max(rt[-1]) > 5.0), {Q.fit_sql("c", "cw", "cp", TOLERANCE)},
  cz AS (SELECT node_id AS cls, position, u, info, CASE WHEN info > 0 THEN u / sqrt(info) ELSE 0.0 END AS z, n FROM cfit JOIN cw USING (node_id))"""


@query("t10_position_fit", L.sql("points", f"{FIT} SELECT cls, round(position, 5) AS position, round(u, 5) AS u, round(info, 5) AS info, round(z, 5) AS z, round(CASE WHEN z > 0 THEN {Q.normal_tail_sql('z')} ELSE 0.5 END, 8) AS p_value, n AS n_replicates FROM cz"))
def t10(spark, d):
    r = node_traces(spark, d)
    named = T.baselines(r.select(F.col("key").alias("compound_id"), F.lit("Count").alias("channel"), "rt", "y"))
    base = named.select(F.col("compound_id").alias("key"), F.col("baseline_mu").alias("mu"), F.col("dispersion").alias("r"))
    fits = D.positions_fit(r.withColumn("cls", F.split("key", r"\|")[2]), base, TOLERANCE, 5.0)
    return rounded(rounded(fits, "position", "u", "info", "z", digits=5), "p_value", digits=8)


PEDIGREE = f"{MEMBERS}, {Q.base_sql(ALPHA)}, {Q.pedigree_sql(TOLERANCE, ALPHA)}"


def pedigree_sql(body: str) -> str:
    return Q.stepwise(L.sql("rt_rows points", f"{PEDIGREE} {body}"))


@query("t11_bayesian_pick", pedigree_sql("SELECT node_id, round(bayesian_pick, 5) AS bayesian_pick, round(bayesian_pick_posterior, 5) AS bayesian_pick_posterior, round(bayesian_pick_runner_up_posterior, 5) AS bayesian_pick_runner_up_posterior FROM oc WHERE bayesian_pick IS NOT NULL"))
def t11(spark, d):
    _, o = evaluated(spark, d)
    found = o.where("bayesian_pick is not null").select("node_id", "bayesian_pick", "bayesian_pick_posterior", "bayesian_pick_runner_up_posterior")
    return rounded(found, "bayesian_pick", "bayesian_pick_posterior", "bayesian_pick_runner_up_posterior", digits=5)


def with_threshold(spark, d, nodes, threshold):
    return D.replicates(members(spark, d).where(nodes), node_traces(spark, d)).withColumn("threshold", F.lit(threshold))


def consensus_at(nodes: str, threshold: float) -> str:
    gate = f"gt AS (SELECT node_id, CAST({threshold} AS DOUBLE) AS threshold FROM nodes WHERE {nodes})"
    return Q.stepwise(L.sql("rt_rows points", f"{MEMBERS}, {Q.base_sql(ALPHA)}, {gate}, {Q.consensus_sql('x', 'gt', TOLERANCE, ALPHA)} {Q.shown_sql('xoc')}"))


@query("t12_class_consensus", consensus_at("tier > 0", 5.0))
def t12(spark, d):
    return shown(D.consensus_of(with_threshold(spark, d, "tier > 0", 5.0), find_many, TOLERANCE, ALPHA))


@query("t13_pedigree_evaluation", pedigree_sql(Q.shown_sql("oc")))
def t13(spark, d):
    return shown(evaluated(spark, d)[1])


OLD_PEDIGREE = f"{MEMBERS}, {Q.base_sql(ALPHA, old_peaks_sql(OLD))}, {Q.pedigree_sql(TOLERANCE, ALPHA)}"


@query("t13b_pedigree_gaussian", Q.stepwise(L.sql("rt_rows points", f"{OLD_PEDIGREE} {Q.shown_sql('oc', 1000)}")))
def t13_gaussian(spark, d):
    """The pedigree with the Gaussian picker, whose peaks lie between samples: listed in thousandths of a month."""
    return shown(evaluated(spark, d, T.picker("gaussian", options=OLD))[1], 1000)


SPLIT = f""", pt AS (SELECT list_reverse(list_resize(CAST([] AS VARCHAR[]), 3 - len(c), 'AgxNull') || c) AS p, round(chosen_rt, 5) AS rt, CASE WHEN kind = 'compound' THEN passed END AS passed
    FROM oc JOIN nodes USING (node_id) WHERE tier > 0 AND chosen_rt IS NOT NULL),
  pk AS (WITH {PEAKS_SQL} SELECT compound_id, max(rt) AS rt FROM peaks WHERE channel = 'Count' GROUP BY 1),
  job AS (SELECT t.bb1, t.bb2, t.bb3, coalesce(pt.rt, pk.rt) AS rt, CASE WHEN pt.rt IS NOT NULL THEN 'pedigree' WHEN pk.rt IS NOT NULL THEN 'peak_pick' ELSE 'none' END AS rt_source, pt.passed
    FROM rt_rows t LEFT JOIN pt ON pt.p = [t.bb1, t.bb2, t.bb3] LEFT JOIN pk ON pk.compound_id = t.bb1 || '|' || t.bb2 || '|' || t.bb3),
  timed AS (SELECT * FROM job WHERE rt IS NOT NULL), {VERIFIED.replace("rt_rows", "timed")}"""


def pedigree_job(spark, d):
    """row_no, bb1..bb3, rt, rt_source, passed: times of the library's tuples from the pedigree's evaluation, else from their own
    latest peaks, and how the pedigree judged whole products."""
    tuples = L.rt_rows(spark, d).select("row_no", *S.BBS)
    found = S.outcome_times(evaluated(spark, d)[1]).withColumn("rt", F.round("rt", 5))
    picks = T.direct_rt(T.pick(P.traces(L.points(spark, d).where("channel = 'Count'")), alpha=PICK_ALPHA)).select(*L.own_blocks(), "rt")
    times = S.resolve_times(tuples, {"pedigree": found, "peak_pick": picks})
    return sheets.stored_table(times.join(found.drop("rt"), S.BBS, "left"), folder(spark))  # verification reads it often


@query("t23e_split_tree_of_pedigree", pedigree_sql(f"{SPLIT} SELECT bb1, bb2, bb3, job.rt, rt_source, passed, success FROM job LEFT JOIN vf USING (bb1, bb2, bb3)"))
def t23_pedigree(spark, d):
    times = pedigree_job(spark, d)
    return times.drop("row_no").join(S.split_tree(times, THR).drop("rt"), S.BBS, "left")


@query("t23f_split_tree_paths_of_pedigree", pedigree_sql(f"{SPLIT} SELECT CAST(d AS INTEGER) AS depth, array_to_string([bb1, bb2, bb3][1:d], '|') AS prefix, max(CASE WHEN d = 3 THEN rt END) AS rt FROM pd, range(1, 4) g(d) WHERE success GROUP BY 1, 2"))
def t23_pedigree_paths(spark, d):
    return S.tree_paths(S.split_tree(pedigree_job(spark, d), THR))


PRODUCTS = """pq AS (SELECT array_to_string(list_reverse(string_split(nt.key, '|')), '|') AS compound_id, node_id, chosen_rt, rt, y, list_sort(list_transform(range(1, len(rt) + 1), lambda i: struct_pack(d := abs(rt[i] - chosen_rt), i := i)))[1].i AS i
    FROM oc JOIN nodes USING (node_id) JOIN members USING (node_id) JOIN nt ON nt.key = members.key WHERE nodes.kind = 'compound' AND passed AND chosen_rt IS NOT NULL AND len(rt) > 2),
  pp AS (SELECT compound_id, node_id, chosen_rt, y[i] - greatest(least(y[i], coalesce(list_min(y[coalesce(list_max(list_filter(range(1, i), lambda l: y[l] > y[i])), 0) + 1 : i - 1]), y[i])),
      least(y[i], coalesce(list_min(y[i + 1 : coalesce(list_min(list_filter(range(i + 1, len(y) + 1), lambda q: y[q] > y[i])), len(y) + 1) - 1]), y[i]))) AS prominence FROM pq)"""


def compounds(spark, d):
    """compound_id (C to N), shown (N to C) and primary_id of the library's compounds."""
    rows = L.rt_rows(spark, d)
    return rows.select(F.concat_ws("|", *S.BBS).alias("compound_id"), F.concat_ws("-", *reversed(S.BBS)).alias("shown"), F.concat(F.lit("R"), F.col("row_no").cast("string")).alias("primary_id"))


def prominences(spark, d, m, o):
    """The chosen times are in minutes where the traces' are in seconds, as far as units go: both ways and back."""
    tr = node_traces(spark, d).select(F.array_join(F.reverse(F.split("key", r"\|")), "|").alias("compound_id"), F.lit("Count").alias("channel"), "rt", "y")
    in_minutes = o.select("node_id", "passed", (F.col("chosen_rt") / 60).alias("chosen_rt"))
    found = D.product_prominence(D.nodes(m), in_minutes, compounds(spark, d), tr, "minutes", "seconds")
    return found.withColumn("chosen_rt", F.col("chosen_rt") * 60)


@query("t14_product_prominence", pedigree_sql(f", {PRODUCTS} SELECT compound_id, node_id, round(chosen_rt, 5) AS chosen_rt, round(prominence, 5) AS prominence FROM pp"))
def t14(spark, d):
    return rounded(prominences(spark, d, *evaluated(spark, d)), "chosen_rt", "prominence", digits=5)


@query("t15_class_diagnostics", consensus_at("node_id IN ('C1_B1', 'C2_B1_B2')", 10.0))
def t15(spark, d):
    some = with_threshold(spark, d, F.col("node_id").isin("C1_B1", "C2_B1_B2"), 10.0)  # the two classes that are asked for
    return shown(D.consensus_of(some, find_many, TOLERANCE, ALPHA))


FULL = "f AS (SELECT bb1, bb2, bb3 FROM rt_rows WHERE bb1 <> 'AgxNull' AND bb2 <> 'AgxNull' AND bb3 <> 'AgxNull')"
ANCESTORS = f"""{FULL}, an AS (SELECT DISTINCT bb1, bb2, bb3, unnest(['C0', 'C1_' || bb3, 'C1_' || bb2, 'C1_' || bb1, 'C2_' || bb3 || '_' || bb2, 'C2_' || bb3 || '_' || bb1, 'C2_' || bb2 || '_' || bb1, 'F3_' || bb3 || '_' || bb2 || '_' || bb1]) AS node_id FROM f)"""


@query("t16_lineage_ancestors", L.sql("rt_rows", f"{ANCESTORS} SELECT * FROM an"))
def t16(spark, d):
    return D.ancestors(L.rt_rows(spark, d))


def panels(spark, d):
    rows = tuples(spark, d)
    return D.lineage(D.ancestors(rows), *evaluated(spark, d, rows=rows))


@query("j15_ancestors_nodes", L.sql("rt_rows", f"{ANCESTORS}, {MEMBERS}, {MADE} SELECT bb1, bb2, bb3, node_id, passed, chosen_rt FROM an JOIN oc USING (node_id)"))
def j15(spark, d):
    return D.ancestors(L.rt_rows(spark, d)).join(simple_outcomes(spark, d), "node_id").select("bb1", "bb2", "bb3", "node_id", "passed", "chosen_rt")


PANELS = f""", {ANCESTORS}, sz AS (SELECT node_id, kind, tier, array_to_string(c, '|') AS class_bbs, CAST(count(*) AS INTEGER) AS n_members FROM members GROUP BY ALL),
  pn AS (SELECT an.*, kind, tier, class_bbs, n_members, oc.node_id IS NOT NULL AS evaluated, coalesce(passed, false) AS passed, coalesce(insufficient_data, false) AS insufficient_data, effective_threshold, score_test_rt, score_test_rt_se, score_test_p_value,
    bayesian_pick, bayesian_pick_posterior, coalesce(n_replicates_with_signal, 0) AS n_with_signal, chosen_rt, list_filter(initial_most_significant_picks, lambda q: q IS NOT NULL)[1] AS first_pick FROM an JOIN sz USING (node_id) LEFT JOIN oc USING (node_id))"""


@query("t17_lineage_analysis", pedigree_sql(f"{PANELS} SELECT bb1, bb2, bb3, node_id, kind, tier, class_bbs, n_members AS n_replicates, evaluated, passed, insufficient_data, round(effective_threshold, 5) AS effective_threshold, round(chosen_rt, 5) AS chosen_rt, n_with_signal AS n_replicates_with_signal FROM pn"))
def t17(spark, d):
    p = panels(spark, d).withColumn("class_bbs", F.array_join("class", "|"))
    p = p.select("bb1", "bb2", "bb3", "node_id", "kind", "tier", "class_bbs", "n_replicates", "evaluated", "passed", "insufficient_data", "effective_threshold", "chosen_rt", "n_replicates_with_signal")
    return rounded(p, "effective_threshold", "chosen_rt", digits=5)


@query("t17b_lineage_failures", L.sql("rt_rows", "SELECT bb1, bb2, bb3, 'no block at a position' AS error FROM rt_rows WHERE bb1 = 'AgxNull' OR bb2 = 'AgxNull' OR bb3 = 'AgxNull'"))
def t17_failures(spark, d):
    return D.lineage_failures(L.rt_rows(spark, d), D.nodes(members(spark, d)))


LABEL_TOLERANCE, MIN_PROMINENCE, MIN_PCT_AREA = 3.0, 10.0, 15.0


def labels_sql(first: str, second: str) -> str:
    """The peaks of the whole traces, by ancestors' times in that order."""
    return f"""{PANELS}, lp AS (SELECT array_to_string(list_reverse(string_split(compound_id, '|')), '|') AS compound_id, rt, intensity, prominence, pct_area FROM peaks),
  la AS (SELECT bb1 || '|' || bb2 || '|' || bb3 AS compound_id, coalesce({first}, {second}, first_pick) AS a_rt, tier,
    CASE WHEN kind = 'compound' THEN 'intended product (' || replace(class_bbs, '|', '-') || ')' WHEN tier = 0 THEN 'root (all null)' ELSE 'null truncation (' || replace(class_bbs, '|', '-') || ')' END AS label FROM pn),
  lc AS (SELECT p.compound_id, p.rt, min_by(label, {{'a': abs(p.rt - a_rt), 'b': -tier, 'c': label}}) AS label FROM lp p JOIN la USING (compound_id) WHERE abs(p.rt - a_rt) <= {LABEL_TOLERANCE} GROUP BY 1, 2),
  lbl AS (SELECT p.*, coalesce(label, 'unknown') AS label FROM lp p LEFT JOIN lc USING (compound_id, rt))
  SELECT compound_id, rt, intensity, label FROM lbl WHERE (prominence >= {MIN_PROMINENCE} AND pct_area >= {MIN_PCT_AREA}) OR starts_with(label, 'null truncation')"""


def labelled(spark, d, order):
    p = panels(spark, d).withColumn("compound_id", F.concat_ws("|", *S.BBS))
    tr = node_traces(spark, d).select(F.array_join(F.reverse(F.split("key", r"\|")), "|").alias("compound_id"), F.lit("Count").alias("channel"), "rt", "y")
    peaks = sheets.stored_table(T.pick(tr, alpha=ALPHA), folder(spark))  # read twice
    return D.peak_labels(peaks, p, LABEL_TOLERANCE, order, MIN_PROMINENCE, MIN_PCT_AREA).select("compound_id", "rt", "intensity", "label")


@query("t18_lineage_peak_labels", pedigree_sql(labels_sql("bayesian_pick", "score_test_rt")))
def t18(spark, d):
    return labelled(spark, d, "kernel")


@query("t18b_peak_labels_score_first", pedigree_sql(labels_sql("score_test_rt", "bayesian_pick")))
def t18_score_first(spark, d):
    return labelled(spark, d, "label")


@query("a22_tier_summary", L.sql("rt_rows", f"{MEMBERS}, {MADE} SELECT tier, count_if(passed) AS pass, count_if(NOT passed) AS fail, count_if(passed IS NULL) AS pruned, count(*) AS total FROM nodes LEFT JOIN oc USING (node_id) GROUP BY ROLLUP (tier)"))
def a22(spark, d):
    return S.tier_summary(simple_outcomes(spark, d), D.nodes(members(spark, d)))


@query("a22_tier_summary_pedigree", pedigree_sql("SELECT tier, count_if(passed) AS pass, count_if(NOT passed) AS fail, count_if(passed IS NULL) AS pruned, count(*) AS total FROM nodes LEFT JOIN oc USING (node_id) GROUP BY ROLLUP (tier)"))
def a22_pedigree(spark, d):
    _, o = evaluated(spark, d)
    return D.tier_summary(o, D.tier_totals(L.rt_rows(spark, d)))


@query("a23_prominence_summary", pedigree_sql(f""", {PRODUCTS} SELECT round(avg(prominence), 6) AS mean, round(coalesce(stddev_samp(prominence), 0), 6) AS std_dev, count(prominence) AS n,
  (SELECT count(*) FROM nodes WHERE kind = 'compound') AS n_compound_nodes, (SELECT count(*) FROM nodes WHERE kind = 'compound') - count(prominence) AS n_skipped FROM pp"""))
def a23(spark, d):
    m, o = evaluated(spark, d)
    return rounded(D.prominence_summary(D.nodes(m), prominences(spark, d, m, o)), "mean", "std_dev")


@query("p26_visible_nodes", L.sql("rt_rows", f"{MEMBERS}, {MADE} SELECT node_id, tier, passed FROM nodes JOIN oc USING (node_id) WHERE tier <= 2 AND passed"))
def p26(spark, d):
    o = simple_outcomes(spark, d).withColumn("insufficient_data", F.lit(False))
    return D.visible(D.nodes(members(spark, d)), o, 2, False).select("node_id", "tier", "passed")


@query("p27_node_status", L.sql("rt_rows", f"{MEMBERS}, {MADE} SELECT node_id, CASE WHEN tier = 0 THEN 'root' WHEN passed AND kind = 'class' THEN 'passed class' WHEN passed THEN 'passed compound' WHEN chosen_rt IS NULL THEN 'insufficient data' ELSE 'failed' END AS status FROM nodes JOIN oc USING (node_id)"))
def p27(spark, d):
    o = D.nodes(members(spark, d)).join(simple_outcomes(spark, d), "node_id")
    return o.select("node_id", D.node_status(F.col("passed"), F.col("chosen_rt").isNull(), F.col("tier"), F.col("kind")).alias("status"))


SETTINGS = f"'Count' AS channel, CAST({ALPHA} AS DOUBLE) AS alpha, CAST({TOLERANCE} AS DOUBLE) AS tolerance, 'seconds' AS time_unit"


@query("s11_pedigree_sink", pedigree_sql(f""", ls AS (SELECT node_id, kind, tier, array_to_string(any_value(c), '-') AS label, list_resize(CAST([] AS VARCHAR[]), 3 - tier, 'AgxNull') || any_value(c) AS p, string_agg(replace(key, '|', '-'), '|' ORDER BY ord) AS members FROM members GROUP BY 1, 2, 3)
  SELECT ls.node_id AS id, label, tier, kind, CAST(oc.node_id IS NOT NULL AS INTEGER) AS evaluated, CAST(coalesce(passed, false) AS INTEGER) AS passed, CAST(coalesce(insufficient_data, false) AS INTEGER) AS insufficient_data, round(chosen_rt, 5) AS chosen_rt,
    round(effective_threshold, 5) AS effective_threshold, round(score_test_rt, 5) AS score_test_rt, round(score_test_p_value, 5) AS score_test_p, round(bayesian_pick, 5) AS bayesian_pick, round(bayesian_pick_posterior, 5) AS bayesian_posterior,
    coalesce(n_replicates, 0) AS n_replicates, coalesce(n_replicates_with_signal, 0) AS n_replicates_with_signal, members, p[3] AS bb_cycle_1, p[2] AS bb_cycle_2, p[1] AS bb_cycle_3, {SETTINGS}, 'All' AS isoform FROM ls LEFT JOIN oc USING (node_id)"""))
def s11(spark, d):
    m, o = evaluated(spark, d)
    out = D.node_table(m, o, "Count", ALPHA, TOLERANCE, "seconds")
    return rounded(sheets.stored_table(out, folder(spark)), "chosen_rt", "effective_threshold", "score_test_rt", "score_test_p", "bayesian_pick", "bayesian_posterior", digits=5)


@query("s12_prominence_sink", pedigree_sql(f", {PRODUCTS} SELECT compound_id, node_id, round(chosen_rt, 5) AS chosen_rt, round(prominence, 5) AS prominence FROM pp"))
def s12(spark, d):
    return sheets.stored_table(t14(spark, d), folder(spark))


LINEAGE_FILE = f"""{PANELS} SELECT bb1 || '-' || bb2 || '-' || bb3 AS compound_id, 'Count' AS channel, tier, class_bbs, node_id, n_members AS n_replicates, CAST(evaluated AS INTEGER) AS evaluated, CAST(passed AS INTEGER) AS passed, CAST(insufficient_data AS INTEGER) AS insufficient_data,
  round(effective_threshold, 5) AS effective_threshold, round(score_test_rt, 5) AS score_test_rt, round(score_test_rt_se, 5) AS score_test_rt_se, round(score_test_p_value, 5) AS score_test_p_value, round(bayesian_pick, 5) AS bayesian_pick, round(bayesian_pick_posterior, 5) AS bayesian_pick_posterior,
  n_with_signal AS n_replicates_with_signal, CAST({ALPHA} AS DOUBLE) AS alpha, CAST({TOLERANCE} AS DOUBLE) AS tolerance, 'seconds' AS time_unit FROM pn"""
LINEAGE_NUMBERS = ["effective_threshold", "score_test_rt", "score_test_rt_se", "score_test_p_value", "bayesian_pick", "bayesian_pick_posterior"]


def lineage_file(spark, d):
    return D.lineage_table(panels(spark, d), "Count", ALPHA, TOLERANCE, "seconds")


@query("s13_lineage_sink", pedigree_sql(LINEAGE_FILE))
def s13(spark, d):
    """Combined: one table, whose compound_id tells rows apart."""
    return rounded(sheets.stored_table(lineage_file(spark, d), folder(spark)), *LINEAGE_NUMBERS, digits=5)


@query("s13b_lineage_sink_separate", pedigree_sql(LINEAGE_FILE))
def s13_separate(spark, d):
    """A folder with a file for each compound, on demand: as many files as compounds."""
    path, out = folder(spark), lineage_file(spark, d)
    files = sheets.write_separately(out, path, "compound_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema if f.name != "compound_id")
    back = sheets.read_separately(files, path, "compound_id", schema)
    back = back.select(*out.columns).withColumn("class_bbs", F.coalesce("class_bbs", F.lit("")))
    return rounded(back, *LINEAGE_NUMBERS, digits=5)
