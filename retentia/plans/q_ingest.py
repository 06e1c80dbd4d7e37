"""Queries of sources, sinks and parsing (S, P, C)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import parse as P
from ..sources import sheets as S
from . import library as L
from .catalog import query

SHEET = P.SheetOptions(metadata=("mass", "run_date"))
#: The parsed sheet in SQL: identity, items, points.
NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
PARSED = f"""ident AS (SELECT *, CASE WHEN id IS NULL OR trim(id) = '' THEN 'missing_id' WHEN trim(variant) = '' THEN 'missing_variant'
    WHEN trim(cell) = '' THEN 'missing_chromatogram' END AS reason0 FROM sheet),
  itemised AS (SELECT *, list_filter(list_transform(regexp_split_to_array(cell, '[,:;]'), lambda x: trim(x)), lambda x: x <> '') AS items FROM ident),
  grouped AS (SELECT *, CASE WHEN len(items) > 0 AND len(items) % 3 = 0 THEN list_transform(range(len(items) // 3), lambda i: items[i * 3 + 1 : i * 3 + 3]) END AS groups FROM itemised),
  numbered AS (SELECT *, list_transform(groups, lambda g: {{'t': CASE WHEN regexp_matches(g[1], {NUM}) THEN CAST(g[1] AS DOUBLE) END,
      'a': CASE WHEN regexp_matches(g[2], {NUM}) THEN greatest(0.0, CAST(g[2] AS DOUBLE)) END,
      'b': CASE WHEN regexp_matches(g[3], {NUM}) THEN greatest(0.0, CAST(g[3] AS DOUBLE)) END}}) AS made FROM grouped),
  cleaned AS (SELECT *, list_filter(made, lambda p: p.t IS NOT NULL AND p.t >= 0 AND (p.a IS NOT NULL OR p.b IS NOT NULL)) AS pts FROM numbered),
  ingested AS (SELECT *, CASE WHEN reason0 IS NOT NULL THEN reason0 WHEN groups IS NULL THEN 'not_divisible' WHEN len(pts) = 0 THEN 'no_valid_points' END AS reason,
      CASE WHEN reason0 IS NULL THEN trim(id) || chr(31) || trim(variant) END AS compound_id FROM cleaned),
  stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY row_no DESC) AS n FROM ingested WHERE reason IS NULL) WHERE n = 1)"""


def ingested(spark, d):
    return P.ingested(L.sheet(spark, d), SHEET)


def stored(spark, d):
    """The sheet's good rows, the last of each storage id."""
    rows = P.good(ingested(spark, d))
    return P.last_wins(rows.select("compound_id", "id", "variant", "cell", "points", "bb1", "bb2", "bb3", "mass", "run_date", "row_no"), ["compound_id"])


def sheet_sql(body: str) -> str:
    return L.sql("sheet", PARSED + "\n" + body)


def folder(spark) -> str:
    return f"{S.shared_dir(spark)}/{uuid.uuid4().hex}"


@query("s01_library_sheet", L.sql("sheet", "SELECT CAST(row_no AS VARCHAR) AS row_no, id, variant, cell, bb1 FROM sheet"))
def s01(spark, d):
    path = folder(spark)
    S.write_csv(L.sheet(spark, d), path)
    return S.read_sheet(spark, path).select("row_no", "id", "variant", "cell", "bb1")


@query("s01b_sheet_with_line_breaks", L.sql("sheet", """SELECT CAST(row_no AS VARCHAR) AS row_no, id, replace(cell, ', ', ',' || chr(10)) AS cell, '"' || bb1 || '",' || chr(10) || bb2 AS note FROM sheet"""))
def s01_line_breaks(spark, d):
    """The sheet with a line for each point of a cell, and a column of quotes, delimiters and line breaks."""
    path = folder(spark)
    note = F.concat(F.lit('"'), "bb1", F.lit('",\n'), "bb2").alias("note")
    S.write_csv(L.sheet(spark, d).select("row_no", "id", F.replace("cell", F.lit(", "), F.lit(",\n")).alias("cell"), note), path)
    return S.read_sheet(spark, path)


@query("s02_identity_rejects", sheet_sql("SELECT row_no, compound_id, reason0 AS reject_reason FROM ingested"))
def s02(spark, d):
    return P.identified(L.sheet(spark, d), SHEET).select("row_no", "compound_id", "reject_reason")


@query("s03_raw_table", sheet_sql("""SELECT compound_id, id AS primary_id, trim(variant) AS variant, cell AS raw, mass, run_date, row_no FROM (
    SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY row_no DESC) AS n FROM ingested WHERE reason0 IS NULL) WHERE n = 1"""))
def s03(spark, d):
    rows = P.good(P.identified(L.sheet(spark, d), SHEET)).select("compound_id", F.col("id").alias("primary_id"), F.trim("variant").alias("variant"), F.col("cell").alias("raw"), "mass", "run_date", "row_no")
    return S.stored_table(P.last_wins(rows, ["compound_id"]), folder(spark))


POINTS_SQL = """SELECT compound_id, 'Count' AS channel, p.t AS time, p.a AS count FROM (SELECT compound_id, unnest(pts) AS p FROM stored) WHERE p.a IS NOT NULL
  UNION ALL SELECT compound_id, 'Scaled', p.t, p.b FROM (SELECT compound_id, unnest(pts) AS p FROM stored) WHERE p.b IS NOT NULL"""


@query("s04_points_table", sheet_sql(POINTS_SQL))
def s04(spark, d):
    return S.stored_table(P.long_points(stored(spark, d)), folder(spark))


def bb_index_file(spark, d):
    """name,index lines with a header and a line that is wrong, as a text file."""
    lines = L.table(spark, d, "part").select(F.concat(F.regexp_replace("p_name", ",", " "), F.lit(","), F.when(F.col("p_partkey") % 50 == 7, "x").otherwise(F.col("p_partkey").cast("string"))).alias("value"))
    path = folder(spark)
    spark.range(1).select(F.lit("name,index").alias("value")).union(lines).write.text(path)
    return path


@query("s05_bb_index_source", """SELECT trim(p_name) AS name, CASE WHEN p_partkey % 50 <> 7 THEN p_partkey END AS index, p_partkey % 50 <> 7 AS ok FROM part""")
def s05(spark, d):
    return S.read_bb_index(spark, bb_index_file(spark, d))


@query("s06_reference_times", L.sql("library", "SELECT DISTINCT round(time / 7, 1) AS time FROM library"))
def s06(spark, d):
    path = folder(spark)
    times = L.library(spark, d).select((F.col("time") / 7).cast("string").alias("value"))
    times.union(spark.range(1).select(F.lit("# reference times"))).union(spark.range(1).select(F.lit(" "))).write.text(path)
    return S.read_times(spark, path, 1)


@query("s07_traces", L.sql("parts", "SELECT compound_id, channel, array_to_string(list(CAST(CAST(time AS INTEGER) AS VARCHAR) ORDER BY time), ' ') AS rt, array_to_string(list(CAST(CAST(count AS INTEGER) AS VARCHAR) ORDER BY time), ' ') AS y FROM parts GROUP BY 1, 2"))
def s07(spark, d):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), " ").alias(c)
    return P.traces(L.parts(spark, d)).select("compound_id", "channel", joined("rt"), joined("y"))


def repeats(spark, d, value, rows):
    """compound_id, row_no, cell: a sheet row for each part, with a `month:value` point for each of its lines, in their order;
    months repeat. rows: which parts."""
    t = L.table(spark, d, "lineitem").where(rows)
    item = F.struct("l_orderkey", "l_linenumber", F.concat(L.months(F.col("l_shipdate")).cast("int").cast("string"), F.lit(":"), value.cast("int").cast("string")).alias("x"))
    cells = t.groupBy("l_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.x), ", ").alias("cell"))
    return cells.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("compound_id"), F.col("l_partkey").alias("row_no"), "cell")


REPEATS = P.SheetOptions(delimiters=(",", ":"), time_index=0, counts={"Count": 1})
REWRITTEN = f"""rp AS (SELECT 'P' || l_partkey AS compound_id, CAST({L._MONTH} AS DOUBLE) AS time, l_orderkey AS o, l_linenumber AS l,
    CASE WHEN l_partkey % 10 = 3 THEN floor(l_extendedprice) ELSE CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS count
  FROM lineitem WHERE l_partkey % 10 <> 3 OR l_linenumber <> 2)"""


def rewritten(spark, d):
    """A store of all parts' points (quantities), in which a tenth of the parts is then written anew: other counts, and fewer."""
    from ..sources.points import PointsStore

    path = folder(spark)
    store = PointsStore.create(spark, f"points_{path.rsplit('/', 1)[-1]}", path)
    parsed = lambda rows: rows.select("compound_id", "row_no", P.clean_points(P.group_items(P.split_items(F.col("cell"), REPEATS.delimiters), 2), REPEATS).alias("points"))
    store.write(parsed(repeats(spark, d, F.col("l_quantity"), F.lit(True))), 1)
    store.write(parsed(repeats(spark, d, F.floor("l_extendedprice"), (F.col("l_partkey") % 10 == 3) & (F.col("l_linenumber") != 2))), 2)
    return store


@query("s04b_points_rewritten", f"WITH {REWRITTEN} SELECT compound_id, time, count FROM rp")
def s04_rewritten(spark, d):
    return rewritten(spark, d).points().select("compound_id", "time", "count")


@query("s07b_traces_last_wins", "WITH " + REWRITTEN + """, one AS (SELECT compound_id, time, max_by(count, {'o': o, 'l': l}) AS count, max(count) AS most FROM rp GROUP BY 1, 2)
  SELECT compound_id, array_to_string(list(CAST(CAST(time AS INTEGER) AS VARCHAR) ORDER BY time), ' ') AS rt, array_to_string(list(CAST(CAST(count AS INTEGER) AS VARCHAR) ORDER BY time), ' ') AS y, count_if(count < most) AS not_largest FROM one GROUP BY 1""")
def s07_last(spark, d):
    """Traces of the rewritten store, and at how many times the last count isn't the largest."""
    store = rewritten(spark, d)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), " ").alias(c)
    largest = P.traces(store.points()).select("compound_id", "channel", F.col("y").alias("most"))
    less = F.size(F.filter(F.zip_with("y", "most", lambda a, b: a < b), lambda x: x)).cast("long").alias("not_largest")
    return store.traces().join(largest, ["compound_id", "channel"]).select("compound_id", joined("rt"), joined("y"), less)


@query("p01_delimiter_parse", sheet_sql("SELECT row_no, array_to_string(items, '|') AS items FROM itemised"))
def p01(spark, d):
    return L.sheet(spark, d).select("row_no", F.array_join(P.split_items(F.col("cell"), SHEET.delimiters), "|").alias("items"))


@query("p02_group_points", sheet_sql("SELECT row_no, len(groups) AS n_points, array_to_string(groups[1], '|') AS first_point FROM grouped"))
def p02(spark, d):
    g = P.group_items(P.split_items(F.col("cell"), SHEET.delimiters), 3)
    n = F.when(g.isNotNull(), F.size(g)).cast("long")
    return L.sheet(spark, d).select("row_no", n.alias("n_points"), F.array_join(F.get(g, F.lit(0)), "|").alias("first_point"))


@query("p03_fields_per_point", sheet_sql("SELECT 3 AS fields, count(*) AS rows, count_if(len(items) % 3 = 0) AS divisible FROM itemised"))
def p03(spark, d):
    k = P.SheetOptions().fields_per_point
    n = F.size(P.split_items(F.col("cell"), SHEET.delimiters))
    return L.sheet(spark, d).agg(F.lit(k).alias("fields"), F.count("*").alias("rows"), F.count_if(n % k == 0).alias("divisible"))


@query("p03b_fields_rule_branches", sheet_sql("SELECT rule, fields, count(*) AS rows, count_if(len(items) % fields = 0) AS divisible FROM itemised, (VALUES ('given', 2), ('delimiters', 3), ('largest index', 5)) r(rule, fields) GROUP BY 1, 2"))
def p03_branches(spark, d):
    """Each branch of the rule, over the sheet's cells."""
    options = {"given": P.SheetOptions(fields=2), "delimiters": P.SheetOptions(), "largest index": P.SheetOptions(delimiters=(), counts={"Count": 1, "Scaled": 4})}
    n = F.size(P.split_items(F.col("cell"), SHEET.delimiters))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(o.fields_per_point).alias("fields")) for r, o in options.items()))).alias("r")
    rows = L.sheet(spark, d).select(n.alias("n"), rules).select("n", "r.*")
    return rows.groupBy("rule", "fields").agg(F.count("*").alias("rows"), F.count_if(F.col("n") % F.col("fields") == 0).alias("divisible"))


@query("p04_point_cleaning", sheet_sql("SELECT row_no, len(pts) AS n_points, round(list_sum(list_transform(pts, lambda p: coalesce(p.a, 0))), 6) AS sum_count, round(list_sum(list_transform(pts, lambda p: p.t)), 6) AS sum_time FROM ingested WHERE groups IS NOT NULL"))
def p04(spark, d):
    rows = ingested(spark, d).where(F.col("groups").isNotNull())
    total = lambda f: F.aggregate("points", F.lit(0.0), lambda a, p: a + f(p))
    count = lambda p: F.aggregate(F.filter(p["counts"], lambda c: c["channel"] == "Count"), F.lit(0.0), lambda a, c: a + c["count"])
    return rows.select("row_no", F.size("points").cast("long").alias("n_points"), F.round(total(count), 6).alias("sum_count"), F.round(total(lambda p: p["time"]), 6).alias("sum_time"))


@query("p05_validation_report", sheet_sql(f"""SELECT row_no, CASE WHEN len(items) = 0 THEN 'empty' WHEN len(items) % 3 <> 0 THEN 'ragged points'
    WHEN len(list_filter(groups, lambda g: NOT regexp_matches(g[1], {NUM}))) > 0 THEN 'non-numeric time'
    WHEN len(list_filter(groups, lambda g: NOT regexp_matches(g[2], {NUM}))) > 0 THEN 'non-numeric Count'
    WHEN len(list_filter(groups, lambda g: NOT regexp_matches(g[3], {NUM}))) > 0 THEN 'non-numeric Scaled' END AS message FROM grouped"""))
def p05(spark, d):
    return ingested(spark, d).select("row_no", P.validation_message(F.col("groups"), F.col("items"), SHEET).alias("message"))


@query("p06_parse_preview", sheet_sql("SELECT row_no, array_to_string(items[1:100], '|') AS items, CAST(len(items) AS INTEGER) AS n_items, len(items) > 0 AND len(items) % 3 = 0 AS ok FROM itemised ORDER BY row_no LIMIT 10"))
def p06(spark, d):
    return P.preview(L.sheet(spark, d), SHEET)


@query("p07_metadata_projection", sheet_sql("SELECT compound_id, coalesce(mass, '') AS mass, coalesce(run_date, '') AS run_date FROM stored"))
def p07(spark, d):
    return P.metadata(stored(spark, d), ["mass", "run_date"])


@query("p08_metadata_merge", L.sql("sheet", "SELECT row_no, CASE WHEN trim(mass) <> '' THEN mass ELSE run_date END AS merged FROM sheet"))
def p08(spark, d):
    return L.sheet(spark, d).select("row_no", P.fill_blank(F.col("mass"), F.col("run_date")).alias("merged"))


@query("p09_unit_conversion", L.sql("parts", "SELECT compound_id, channel, round(sum(time / 60), 6) AS minutes, round(sum(time * 60), 6) AS seconds FROM parts GROUP BY 1, 2"))
def p09(spark, d):
    t = F.col("time")
    return L.parts(spark, d).groupBy("compound_id", "channel").agg(F.round(F.sum(P.in_unit(t, "seconds", "minutes")), 6).alias("minutes"), F.round(F.sum(P.in_unit(t, "minutes", "seconds")), 6).alias("seconds"))


@query("p10_channel_extraction", L.sql("parts", "SELECT compound_id, time, count FROM parts WHERE channel = 'Scaled' AND count IS NOT NULL"))
def p10(spark, d):
    return L.parts(spark, d).where((F.col("channel") == "Scaled") & F.col("count").isNotNull()).select("compound_id", "time", "count")


@query("p11_isoform_filter", L.sql("sheet", "SELECT row_no, id, variant FROM sheet WHERE trim(variant) = 'cyclic'"))
def p11(spark, d):
    return K.isoforms(L.sheet(spark, d), ["cyclic"]).select("row_no", "id", "variant")


@query("p23_rt_cell", L.sql("sheet", f"SELECT row_no, CASE WHEN regexp_matches(trim(mass), {NUM}) THEN CAST(mass AS DOUBLE) END AS rt FROM sheet"))
def p23(spark, d):
    return L.sheet(spark, d).select("row_no", P.rt_value(F.col("mass")).alias("rt"))


@query("p24_rt_unit", L.sql("sheet", f"SELECT 'minutes' AS unit, round(sum(CASE WHEN regexp_matches(trim(mass), {NUM}) THEN CAST(mass AS DOUBLE) * 60 END), 3) AS seconds FROM sheet"))
def p24(spark, d):
    unit = P.rt_unit("RT (min)")
    return L.sheet(spark, d).agg(F.lit(unit).alias("unit"), F.round(F.sum(P.in_unit(P.rt_value(F.col("mass")), unit, "seconds")), 3).alias("seconds"))


@query("p25_cyclised_rt", L.sql("sheet", f"SELECT row_no, CASE WHEN regexp_matches(trim(mass), {NUM}) THEN CAST(mass AS DOUBLE) WHEN regexp_matches(trim(id), {NUM}) THEN CAST(id AS DOUBLE) END AS rt FROM sheet"))
def p25(spark, d):
    named = L.sheet(spark, d).withColumnsRenamed({"mass": "Cyclized RT", "id": "cyclized rt 2"})
    return named.select("row_no", K.cyclised_rt(named).alias("rt"))


@query("p28_full_products", L.sql("rt_rows", "SELECT row_no, bb1, bb2, bb3 FROM rt_rows WHERE bb1 <> 'AgxNull' AND bb2 <> 'AgxNull' AND bb3 <> 'AgxNull'"))
def p28(spark, d):
    return L.rt_rows(spark, d).where(K.is_full(L.positions(), 3)).select("row_no", "bb1", "bb2", "bb3")


@query("p29_bb_subset", L.sql("rt_rows", "SELECT row_no FROM rt_rows WHERE bb1 IN ('B1','B3','AgxNull') AND bb2 IN ('B1','B3','AgxNull') AND bb3 IN ('B1','B3','AgxNull')"))
def p29(spark, d):
    return L.rt_rows(spark, d).where(K.only_blocks(L.positions(), ["B1", "B3"])).select("row_no")


@query("p30_library_gate", L.sql("parts", "SELECT compound_id, max(count) AS max_count FROM parts WHERE channel = 'Scaled' GROUP BY 1 HAVING max(count) >= 30 AND CAST(substr(compound_id, 2) AS BIGINT) % 3 = 1"))
def p30(spark, d):
    lid = F.pmod(F.substring("compound_id", 2, 20).cast("long"), F.lit(3))
    best = L.parts(spark, d).where((F.col("channel") == "Scaled") & (lid == 1)).groupBy("compound_id").agg(F.max("count").alias("max_count"))
    return best.where("max_count >= 30")


@query("p31_tolerant_parse", L.sql("sheet", f"""tol AS (SELECT row_no, unnest(list_transform(string_split(cell, ','), lambda x: trim(x))) AS x FROM sheet),
  halves AS (SELECT row_no, string_split(x, ':')[1] AS t, string_split(string_split(x, ':')[2], ';')[2] AS c FROM tol)
  SELECT row_no, count(*) AS n_points, round(sum(CAST(t AS DOUBLE) * 60), 4) AS sum_time, sum(CAST(c AS DOUBLE)) AS sum_count FROM halves
  WHERE regexp_matches(trim(t), {NUM}) AND regexp_matches(trim(c), {NUM}) GROUP BY 1"""))
def p31(spark, d):
    p = L.sheet(spark, d).select("row_no", F.explode(P.tolerant_points(F.col("cell"), 1, 60.0)).alias("p"))
    return p.groupBy("row_no").agg(F.count("*").alias("n_points"), F.round(F.sum("p.time"), 4).alias("sum_time"), F.sum("p.count").alias("sum_count"))


CLASS = "list_filter([bb1, bb2, bb3], lambda x: x <> 'AgxNull')"


@query("c01_normalise_name", "SELECT p_partkey, trim(p_name) || 'é' AS name FROM part")
def c01(spark, d):
    # the last letter is written as e and a combining accent, and comes out composed
    return L.table(spark, d, "part").select("p_partkey", K.normalise(F.concat(F.lit(" "), "p_name", F.lit("é "))).alias("name"))


@query("c02_canonical_positions", L.sql("rt_rows", "SELECT row_no, replace(upper(bb1), 'AGXNULL', 'AgxNull') AS bb1 FROM rt_rows"))
def c02(spark, d):
    rows = L.rt_rows(spark, d)
    spelled = rows.select("row_no", F.when(F.col("row_no") % 2 == 0, F.lower("bb1")).otherwise(F.col("bb1")).alias("bb"))
    known = K.canonical_names(rows.select(F.col("bb1").alias("name")))
    return K.canonical(spelled, "bb", known).select("row_no", F.col("bb").alias("bb1"))


@query("c03_storage_id", sheet_sql("SELECT row_no, trim(id) AS primary_id, trim(variant) AS variant FROM ingested WHERE reason0 IS NULL"))
def c03(spark, d):
    rows = P.good(P.identified(L.sheet(spark, d), SHEET))
    parts = F.split("compound_id", P.SEPARATOR, 2)
    return rows.select("row_no", parts[0].alias("primary_id"), parts[1].alias("variant"))


@query("c04_tier_class_label", L.sql("rt_rows", f"SELECT row_no, CAST(len({CLASS}) AS INTEGER) AS tier, array_to_string({CLASS}, '-') AS label FROM rt_rows"))
def c04(spark, d):
    p = L.positions()
    return L.rt_rows(spark, d).select("row_no", K.tier(p).alias("tier"), K.label(p).alias("label"))


@query("c05_class_parents", L.sql("rt_rows", f"""cls AS (SELECT row_no, {CLASS} AS c FROM rt_rows), par AS (
  SELECT row_no, unnest(list_transform(range(len(c)), lambda i: array_to_string(c[:i] || c[i + 2 :], '-'))) AS parent FROM cls)
  SELECT DISTINCT row_no, parent FROM par"""))
def c05(spark, d):
    rows = L.rt_rows(spark, d).select("row_no", F.explode(K.parents(K.class_of(L.positions()))).alias("p"))
    return rows.select("row_no", F.array_join("p", "-").alias("parent"))


@query("c06_node_id", L.sql("rt_rows", f"SELECT row_no, CASE WHEN len({CLASS}) = 3 THEN 'F3_' || bb1 || '_' || bb2 || '_' || bb3 ELSE array_to_string(['C' || len({CLASS})] || {CLASS}, '_') END AS node_id FROM rt_rows"))
def c06(spark, d):
    return L.rt_rows(spark, d).select("row_no", K.node_id(L.positions(), 3).alias("node_id"))


@query("c07_positions_from_class", L.sql("rt_rows", f"SELECT row_no, array_to_string(list_resize(CAST([] AS VARCHAR[]), 3 - len({CLASS}), 'AgxNull') || {CLASS}, '|') AS positions FROM rt_rows"))
def c07(spark, d):
    return L.rt_rows(spark, d).select("row_no", F.array_join(K.padded(K.class_of(L.positions()), 3), "|").alias("positions"))


@query("c08_reverse", L.sql("rt_rows", "SELECT row_no, bb3 || '|' || bb2 || '|' || bb1 AS positions FROM rt_rows"))
def c08(spark, d):
    return L.rt_rows(spark, d).select("row_no", F.array_join(F.reverse(L.positions()), "|").alias("positions"))


@query("c09_cassette", L.sql("rt_rows", "SELECT row_no, bb1 = 'B3' AS is_cassette, CASE WHEN bb1 = 'B3' THEN 'B1|B2' ELSE bb1 END AS components FROM rt_rows"))
def c09(spark, d):
    bb = F.when(F.col("bb1") == "B3", "B1-B2").otherwise(F.col("bb1"))
    return L.rt_rows(spark, d).select("row_no", K.is_cassette(bb).alias("is_cassette"), F.array_join(K.components(bb), "|").alias("components"))


@query("c10_null_masks", L.sql("rt_rows", """m AS (SELECT row_no, bb1, bb2, bb3, unnest(range(1, 8)) AS mask FROM rt_rows)
  SELECT row_no, CASE WHEN mask & 1 > 0 THEN 'AgxNull' ELSE bb1 END || '|' || CASE WHEN mask & 2 > 0 THEN 'AgxNull' ELSE bb2 END || '|' || CASE WHEN mask & 4 > 0 THEN 'AgxNull' ELSE bb3 END AS masked FROM m"""))
def c10(spark, d):
    return L.rt_rows(spark, d).select("row_no", F.explode(K.null_masks(L.positions(), 3)).alias("p")).select("row_no", F.array_join("p", "|").alias("masked"))


@query("c11_is_truncation", L.sql("rt_rows", """SELECT row_no, (bb1 = 'AgxNull' OR bb1 = 'B1') AND (bb2 = 'AgxNull' OR bb2 = 'B2') AND (bb3 = 'AgxNull' OR bb3 = 'B3')
  AND NOT (bb1 = 'B1' AND bb2 = 'B2' AND bb3 = 'B3') AS truncation FROM rt_rows"""))
def c11(spark, d):
    return L.rt_rows(spark, d).select("row_no", K.is_truncation(L.positions(), F.array(*map(F.lit, ("B1", "B2", "B3")))).alias("truncation"))


@query("c14_legacy_gaussian", L.sql("parts", "SELECT compound_id, channel, time, round(10 * exp(-pow((time - 40) / (2 * 7.5), 2)), 9) AS g FROM parts"))
def c14(spark, d):
    return L.parts(spark, d).select("compound_id", "channel", "time", F.round(K.gaussian(F.col("time"), 10.0, 40.0, 7.5), 9).alias("g"))


@query("c15_rt_header", L.sql("rt_rows", 'SELECT row_no, rt / 60 AS "assigned_rt (min)" FROM rt_rows'))
def c15(spark, d):
    return L.rt_rows(spark, d).select("row_no", P.in_unit(F.col("rt"), "seconds", "minutes").alias(K.rt_header("assigned_rt", "minutes")))


@query("c16_safe_stem", "SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g') AS stem FROM part")
def c16(spark, d):
    return L.table(spark, d, "part").select("p_partkey", K.safe_stem(F.concat("p_name", F.lit("/"), "p_brand")).alias("stem"))


@query("c17_rt_offset", L.sql("rt_rows", "SELECT row_no, greatest(-1.0, least(1.0, (rt - 40) / 10)) AS rt_offset FROM rt_rows"))
def c17(spark, d):
    return L.rt_rows(spark, d).select("row_no", K.rt_offset(F.col("rt"), F.lit(40.0)).alias("rt_offset"))
