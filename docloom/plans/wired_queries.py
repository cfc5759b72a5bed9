"""Queries of operators that the engine puts together: cells, siblings, scopes, roles, listings and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import cells, contents, evidence, metrics, search, structure, tables
from docloom.plans.registry import query, table
from docloom.plans.search_queries import TOKENS
from docloom.plans.structure_queries import POINTS, points


def nation_cells(spark, sf_dir):
    return tables.cells_long(table(spark, sf_dir, "nation"), F.lit("nation"), F.col("n_nationkey"), ["n_name", "n_nationkey", "n_regionkey"])


@query("""SELECT n_nationkey::INT AS row_index, n_name || ' (' || h || ')' AS label, 'n_name ' || n_name || ' ' || h AS description, value FROM (
  SELECT n_nationkey, n_name, unnest(['n_nationkey', 'n_regionkey']) AS h, unnest([n_nationkey::VARCHAR, n_regionkey::VARCHAR]) AS value FROM nation)""")
def matrix_candidates(spark, sf_dir):
    return cells.matrix_candidates(nation_cells(spark, sf_dir)).select("row_index", "label", "description", "value")


@query("""SELECT n_nationkey::INT AS row_index, c AS col_index, last_value(CASE WHEN v <> '' THEN v END IGNORE NULLS) OVER (PARTITION BY n_nationkey ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM (
  SELECT n_nationkey, c, CASE WHEN (n_nationkey + c) % 2 = 0 THEN [n_name, n_nationkey::VARCHAR, n_regionkey::VARCHAR][c + 1] ELSE '' END AS v FROM nation, (SELECT unnest([0, 1, 2])::INT AS c))""")
def fill_right(spark, sf_dir):
    rows = nation_cells(spark, sf_dir).withColumn("value", F.when((F.col("row_index") + F.col("col_index")) % 2 == 0, F.col("value")).otherwise(""))
    return tables.fill_right(rows).select(F.col("row_index").cast("int").alias("row_index"), "col_index", "filled")


@query(f"""WITH {POINTS} SELECT 'd1::hier::' || node_type || '::' || text AS id, row_number() OVER (PARTITION BY path[1:len(path) - 1] ORDER BY 'd1::hier::' || node_type || '::' || text)::INT AS sibling_ordinal FROM p""")
def sibling_ordinals(spark, sf_dir):
    return structure.sibling_ordinals(points(spark, sf_dir)).select("id", "sibling_ordinal")


@query(f"""WITH {POINTS} SELECT 'd1::hier::' || node_type || '::' || text AS id FROM p WHERE path[1:len(path) - 1] = ['ASIA'] OR path[1:len(path) - 1] = ['EUROPE', 'NATION_3']""")
def sibling_points(spark, sf_dir):
    parents = spark.createDataFrame([("d1", ["ASIA"]), ("d1", ["EUROPE", "NATION_3"])], "document_id string, parent array<string>")
    return structure.siblings(points(spark, sf_dir), parents).select("id")


@query(f"""WITH {POINTS} SELECT 'd1::hier::' || node_type || '::' || text AS id FROM p WHERE lower(path[len(path)]) = 'asia'""")
def find_key(spark, sf_dir):
    return structure.find_key(points(spark, sf_dir), "Asia").select("id")


@query("""SELECT r_name AS document_id, path, value FROM (SELECT r_name, r_name AS path, NULL AS value FROM region UNION ALL SELECT r_name, r_name || ' > ' || n_name, n_nationkey::VARCHAR FROM region JOIN nation ON n_regionkey = r_regionkey)""")
def flatten_tree(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at any size
    child = F.struct(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    trees = nation.groupBy("r_name").agg(F.collect_list(child).alias("children")).select(F.col("r_name").alias("document_id"), F.to_json(F.struct(F.col("r_name").alias("key"), "children")).alias("tree"))
    return structure.flatten_tree(trees).select("document_id", F.array_join("path", " > ").alias("path"), "value")


@query("""SELECT doc_id, (contains(lower(text), 'the') OR contains(lower(text), 'that')) AND (contains(lower(text), 'und') OR contains(lower(text), 'and')) AS present FROM documents""")
def role_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", structure.roles_present([["the", "that"], ["und", "and"]], F.col("text")).alias("present"))


@query("""SELECT event_id FROM (SELECT *, max(event_type = 'purchase') OVER (PARTITION BY user_id) AS n FROM events) WHERE NOT n OR event_type = 'purchase'""")
def native_first(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "docx_xml").otherwise("key_value_form")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("document_id"), kind.alias("extraction_method"))
    return metrics.native_first(rows).select("event_id")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def reports_only(spark, sf_dir):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "magazine").otherwise("report")
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), kind.alias("document_type"))
    return metrics.reports_only(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "document_id"), documents).select("o_orderkey")


@query("""SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 2 = 0) >= 5 AND count(*) FILTER (event_id % 2 = 0 AND event_id % 3 = 0) >= 0.6 * count(*) FILTER (event_id % 2 = 0))""")
def not_contents_list(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("numbered", F.col("event_id") % 2 == 0).withColumn("ends", F.col("event_id") % 3 == 0)
    return metrics.not_contents_list(rows, "user_id", "numbered", "ends").select("event_id")


@query(f"""WITH s AS (SELECT DISTINCT p_size, p_name FROM part), w AS (SELECT p_size, p_name, unnest(list_distinct({TOKENS.replace('text', 'p_name')})) AS w FROM s), q AS (SELECT * FROM w WHERE w IN ('small', 'hot', 'widget')),
  d AS (SELECT w, count(*) AS df FROM q GROUP BY 1), c AS (SELECT p_size, p_name, sum(1.0::DOUBLE / df) AS s FROM q JOIN d USING (w) GROUP BY 1, 2), t AS (SELECT coalesce(max(s), 0) AS top FROM c)
  SELECT p_partkey FROM part LEFT JOIN c USING (p_size, p_name), t WHERE top < 0.001 OR coalesce(s, 0) >= top - 0.0005""")
def section_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("section_no"), F.col("p_name").alias("section"))
    return metrics.section_scope(rows, ["small", "hot", "widget"], 0.001, 0.0005).select("p_partkey")


@query("""SELECT DISTINCT page FROM (SELECT unnest([n, n + 1]) AS page FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{1,3}'))::INT AS n FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'license'))) WHERE page BETWEEN 1 AND 300""")
def located_pages(spark, sf_dir):
    return search.located_pages(table(spark, sf_dir, "documents").select("text"), ["token", "license"])


@query("""SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(source), '1')""")
def ui_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("document_type"), F.lit(2024).alias("year"), F.col("source").alias("filename"))
    return evidence.ui_documents(rows, "en", 2024, "1").select("doc_id", F.col("filename").alias("source"))


@query("""SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'widget') OR contains(lower(p_name), 'gizmo')) AND contains(lower(p_name), 'red')""")
def topic_groups(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(contents.topic_groups([["widget", "gizmo"], ["red"]], F.col("p_name"))).select("p_partkey")


@query("""SELECT r_name AS label, change::DOUBLE AS change FROM (SELECT r_name, max(CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey END) - max(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END) AS change FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1) WHERE change IS NOT NULL""")
def comparison_table(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at any size
    wide = metrics.pivot_periods(rows.withColumn("period", (F.col("n_nationkey") % 2).cast("string")).withColumn("v", F.col("n_nationkey").cast("double")), ["r_name"], "period", "v", ["0", "1"], "n_nationkey")
    return evidence.comparison_table(metrics.compare(wide, ["0", "1"]), "r_name", ["0", "1"]).select("label", "change")
