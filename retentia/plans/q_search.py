"""Queries of metadata search, lookups and pages (P12-P20, O, A33-A35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import orders as R
from ..operators import parse as P
from ..operators import search as S
from ..operators import substrings as T
from ..operators.search import Condition
from . import library as L
from .catalog import query
from .q_ingest import NUM, folder, sheet_sql, stored

SHEET_NUM = f"CASE WHEN regexp_matches(trim(mass), {NUM}) THEN CAST(trim(mass) AS DOUBLE) END"


@query("p12_numeric_predicates", L.sql("sheet", f"SELECT row_no, mass FROM sheet WHERE {SHEET_NUM} >= 120 AND {SHEET_NUM} <> 200 AND {SHEET_NUM} < 500"))
def p12(spark, d):
    c = [Condition("mass", ">=", "120"), Condition("mass", "!=", "200", "numeric"), Condition("mass", "<", "500")]
    return S.search(L.sheet(spark, d), c).select("row_no", "mass")


@query("p13_date_predicates", L.sql("sheet", "SELECT row_no, run_date FROM sheet WHERE run_date > '2020-03-01' AND run_date <> '2020-07-15' AND trim(run_date) <> ''"))
def p13(spark, d):
    c = [Condition("run_date", ">", "2020-03-01", "date"), Condition("run_date", "!=", "2020-07-15", "date")]
    return S.search(L.sheet(spark, d), c).select("row_no", "run_date")


@query("p14_text_equality", "SELECT p_partkey, p_type FROM part WHERE lower(trim(p_type)) = 'economy' AND p_brand <> 'Brand#2'")
def p14(spark, d):
    c = [Condition("p_type", "=", "Economy"), Condition("p_brand", "!=", "Brand#2", "text", True)]
    return S.search(L.table(spark, d, "part"), c).select("p_partkey", "p_type")


@query("p15_text_patterns", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'wid') OR starts_with(p_name, 'small') OR ends_with(lower(p_name), 'ring')")
def p15(spark, d):
    c = [Condition("p_name", "contains", "WID"), Condition("p_name", "starts_with", "small", "text", True, "OR"), Condition("p_name", "ends_with", "Ring", combiner="OR")]
    return S.search(L.table(spark, d, "part"), c).select("p_partkey", "p_name")


@query("p16_left_combiner", "SELECT p_partkey FROM part WHERE ((p_size > 10 OR lower(p_type) = 'economy') AND p_retailprice < 1000)")
def p16(spark, d):
    c = [Condition("p_size", ">", "10"), Condition("p_type", "=", "ECONOMY", combiner="OR"), Condition("p_retailprice", "<", "1000")]
    return S.search(L.table(spark, d, "part"), c).select("p_partkey")


@query("p17_loose_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')")
def p17(spark, d):
    return S.contains_any(L.table(spark, d, "part"), "RED", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query("p18_predicate_validation", "SELECT count(*) AS rows, 3 AS errors, 'numeric' AS kind FROM part")
def p18(spark, d):
    parts = L.table(spark, d, "part")
    wrong = S.validate([Condition("nothing", "=", "1"), Condition("p_size", ">", "x"), Condition("p_name", "between", "a", "text")], parts.columns)
    return parts.agg(F.count("*").alias("rows"), F.lit(len(wrong)).alias("errors"), F.lit(Condition("p_size", ">=", "1").resolved).alias("kind"))


@query("p19_simple_filter", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size >= 20")
def p19(spark, d):
    return S.simple_filter(L.table(spark, d, "part"), {"p_type": "ECONOMY", "p_size": {"operator": ">=", "value": 20}}).select("p_partkey")


@query("p20_lookup_primary", sheet_sql("SELECT id AS primary_id, variant, compound_id FROM stored WHERE id IN ('C7', 'C12', 'C25') ORDER BY coalesce(variant, ''), compound_id"))
def p20(spark, d):
    found = stored(spark, d).where(F.col("id").isin("C7", "C12", "C25"))
    return found.orderBy(F.coalesce("variant", F.lit("")), "compound_id").select(F.col("id").alias("primary_id"), "variant", "compound_id")


@query("o01_null_first_sort", L.sql("rt_rows", """SELECT bb1, bb2, bb3, row_number() OVER (ORDER BY bb1 <> 'AgxNull', lower(bb1), bb2 <> 'AgxNull', lower(bb2), bb3 <> 'AgxNull', lower(bb3)) AS place
  FROM rt_rows ORDER BY place LIMIT 60"""))
def o01(spark, d):
    from pyspark.sql import Window

    keys = [k for c in ("bb1", "bb2", "bb3") for k in (F.col(c) != K.NULL, F.lower(c))]
    top = L.rt_rows(spark, d).orderBy(*keys).limit(60)  # the first page of the tree
    return top.select("bb1", "bb2", "bb3", F.row_number().over(Window.orderBy(*keys)).alias("place"))


@query("o01b_null_first_sort_whole", L.sql("rt_rows", """SELECT bb1, bb2, bb3, row_number() OVER (ORDER BY bb1 <> 'AgxNull', lower(bb1), bb2 <> 'AgxNull', lower(bb2), bb3 <> 'AgxNull', lower(bb3)) AS place
  FROM rt_rows"""))
def o01b(spark, d):
    return S.tree_order(L.rt_rows(spark, d), ["bb1", "bb2", "bb3"]).select("bb1", "bb2", "bb3", "place")


@query("o02_paged_search", "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size > 10) AS total FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 40 OFFSET 40")
def o02(spark, d):
    found = S.search(L.table(spark, d, "part"), [Condition("p_size", ">", "10")]).select("p_partkey")
    return R.page(found, "p_partkey", 40, 40)


@query("o02b_deep_page", """SELECT o_orderkey, o_totalprice, total FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS place, count(*) OVER () AS total FROM orders)
  WHERE place > total * 9 // 10 AND place <= total * 9 // 10 + 50""")
def o02_deep(spark, d):
    """The page that begins after nine tenths of the orders."""
    orders = L.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.page(orders, "o_orderkey", orders.count() * 9 // 10, 50)


@query("o03_id_list", "SELECT p_partkey FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 100")
def o03(spark, d):
    return S.search(L.table(spark, d, "part"), [Condition("p_size", ">", "10")]).select("p_partkey").orderBy("p_partkey").limit(100)


@query("o04_value_suggestions", "SELECT DISTINCT p_name AS value FROM part WHERE contains(lower(p_name), 'ri') ORDER BY 1 LIMIT 400")
def o04(spark, d):
    p = L.table(spark, d, "part").where(F.lower("p_name").contains("ri"))
    return p.select(F.col("p_name").alias("value")).distinct().orderBy("value").limit(400)


@query("o04b_suggestions_by_index", "SELECT lower(p_name) AS value, count(*) AS rows FROM part WHERE contains(lower(p_name), 'ring') GROUP BY 1")
def o04_index(spark, d):
    """Every value that holds a text, by a trigram index, with the number of its rows."""
    parts = L.table(spark, d, "part")
    found = T.rows_with(parts, "p_name", T.build(parts, "p_name", folder(spark)), "RING")
    return found.groupBy(F.lower("p_name").alias("value")).agg(F.count("*").alias("rows"))


@query("p15b_contains_by_index", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'mentre')")
def p15_index(spark, d):
    """Rows of long texts that hold a text."""
    docs = L.table(spark, d, "documents")
    return T.rows_with(docs, "text", T.build(docs, "text", folder(spark)), "MentRe").select("doc_id", "n_chars")


@query("o06_branch_order", L.sql("rt_rows", """names AS (SELECT DISTINCT bb1 AS name FROM rt_rows)
  SELECT name, row_number() OVER (ORDER BY CASE name WHEN 'B2' THEN 1 WHEN 'B4' THEN 2 ELSE 1000000000 END, lower(name)) AS place FROM names"""))
def o06(spark, d):
    names = L.rt_rows(spark, d).select(F.col("bb1").alias("name")).distinct()
    index = F.when(F.col("name") == "B2", 1).when(F.col("name") == "B4", 2)
    return R.ranked(names, [F.coalesce(index, F.lit(10**9)), F.lower("name")])


@query("a33_distinct_primary_ids", sheet_sql("SELECT DISTINCT coalesce(id, compound_id) AS primary_id FROM stored"))
def a33(spark, d):
    return stored(spark, d).select(F.coalesce("id", "compound_id").alias("primary_id")).distinct()


@query("a34_distinct_values", """v AS (SELECT DISTINCT trim(p_name) AS value FROM part WHERE trim(p_name) <> '')
  SELECT value, (SELECT count(*) > 20 FROM v) AS truncated FROM v ORDER BY lower(value), value LIMIT 20""".replace("v AS", "WITH v AS", 1))
def a34(spark, d):
    return S.distinct_values(L.table(spark, d, "part"), "p_name", 20)


@query("a35_counts", "SELECT count_if(p_size > 10) AS matching, count(*) AS total FROM part")
def a35(spark, d):
    parts = L.table(spark, d, "part")
    return parts.agg(F.count_if(S.combine([Condition("p_size", ">", "10")])).alias("matching"), F.count("*").alias("total"))


@query("a36_ingest_summary", sheet_sql("SELECT coalesce(reason, 'ok') AS outcome, count(*) AS n FROM ingested GROUP BY 1"))
def a36(spark, d):
    from .q_ingest import ingested

    return ingested(spark, d).groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query("a31_rt_coverage", L.sql("sheet", f"""u AS (SELECT row_no, bb1, 'mass' AS field, mass AS v FROM sheet UNION ALL SELECT row_no, bb1, 'run_date', run_date FROM sheet UNION ALL SELECT row_no, bb1, 'id', id FROM sheet)
  SELECT field, count_if(coalesce(regexp_matches(trim(v), {NUM}), false)) AS numeric_cells, count_if(coalesce(regexp_matches(trim(v), {NUM}), false) AND bb1 <> 'AgxNull') AS with_positions, count(*) AS scanned FROM u GROUP BY 1"""))
def a31(spark, d):
    u = L.sheet(spark, d).unpivot(["row_no", "bb1"], ["mass", "run_date", "id"], "field", "v")
    ok = P.rt_value(F.col("v")).isNotNull()
    return u.groupBy("field").agg(F.count_if(ok).alias("numeric_cells"), F.count_if(ok & (F.col("bb1") != K.NULL)).alias("with_positions"), F.count("*").alias("scanned"))


@query("u01_union_of_times", L.sql("parts", "SELECT DISTINCT round(time / 3, 2) AS time FROM parts"))
def u01(spark, d):
    return L.parts(spark, d).select(F.round(F.col("time") / 3, 2).alias("time")).distinct()


@query("u02_names_at_depth", L.sql("rt_rows", "SELECT bb2 AS name FROM rt_rows WHERE rt > 40 UNION SELECT bb2 FROM rt_rows WHERE bb2 <> 'AgxNull'"))
def u02(spark, d):
    rows = L.rt_rows(spark, d)
    tree, products = rows.where("rt > 40").select(F.col("bb2").alias("name")), rows.where(F.col("bb2") != K.NULL).select(F.col("bb2").alias("name"))
    return tree.union(products).distinct()


@query("u04_missing_extra", "SELECT lower(p_name) AS name, 'missing' AS side FROM (SELECT p_name FROM part WHERE p_size > 25 AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey < 60)) GROUP BY 1 UNION ALL SELECT lower(p_name), 'extra' FROM part WHERE p_partkey < 60 AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size > 25) GROUP BY 1")
def u04(spark, d):
    parts = L.table(spark, d, "part")
    low = lambda df: df.select(F.lower("p_name").alias("name")).distinct()
    found, known = low(parts.where("p_size > 25")), low(parts.where("p_partkey < 60"))
    return found.join(known, "name", "left_anti").withColumn("side", F.lit("missing")).union(known.join(found, "name", "left_anti").withColumn("side", F.lit("extra")))


@query("u04b_missing_extra_whole", """WITH found AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size > 25), known AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_type = 'ECONOMY')
  SELECT name, 'missing' AS side FROM found WHERE name NOT IN (SELECT name FROM known) UNION ALL SELECT name, 'extra' FROM known WHERE name NOT IN (SELECT name FROM found)""")
def u04b(spark, d):
    parts = L.table(spark, d, "part")
    return S.missing_extra(parts.where("p_size > 25"), parts.where("p_type = 'ECONOMY'"), "p_name")
