"""Builder and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import tokens as tk
from docloom.operators import builders, evidence
from docloom.plans.registry import query, table


@query("""SELECT n_name AS row_label, header, value FROM (SELECT n_name, unnest(['n_nationkey', 'n_regionkey']) AS header, unnest([n_nationkey::VARCHAR, n_regionkey::VARCHAR]) AS value FROM nation)""")
def table_leaves(spark, sf_dir):
    from docloom.operators.tables import cells_long

    cells = cells_long(table(spark, sf_dir, "nation"), F.lit("nation"), F.col("n_nationkey"), ["n_nationkey", "n_name", "n_regionkey"]).withColumn("document_id", F.lit("d1"))
    return builders.table_leaves(cells).select(F.col("path")[1].alias("row_label"), F.col("path")[2].alias("header"), "value")


@query("""SELECT section, title, attribute, value FROM (SELECT p_type AS section, p_partkey || ' ' || p_name AS title, unnest(['author', 'page']) AS attribute, unnest([p_brand, p_size::VARCHAR]) AS value FROM part)""")
def contents_leaves(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit("d1").alias("document_id"), F.col("p_type").alias("section_original"), F.concat_ws(" ", "p_partkey", "p_name").alias("title_original"), F.col("p_brand").alias("author_original"), F.col("p_size").alias("page_number"))
    return builders.contents_leaves(rows).select(F.col("path")[0].alias("section"), F.col("path")[1].alias("title"), F.col("path")[2].alias("attribute"), "value")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS value FROM orders WHERE o_orderkey % 2 = 0""")
def period_fields(spark, sf_dir):
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Quarter ending "), F.date_format("o_orderdate", "d.M.yyyy"))).otherwise(F.concat(F.lit("Signed on "), F.date_format("o_orderdate", "d.M.yyyy")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.concat(F.lit("A line\n"), line).alias("text"))
    return builders.period_fields(rows).select(F.col("document_id").cast("long").alias("o_orderkey"), "value")


@query("""SELECT p_brand, (count(*) FILTER (contains(p_name, 'widget') OR contains(p_name, 'gizmo')))::BIGINT AS tools, (count(*) FILTER (contains(p_name, 'red')))::BIGINT AS red FROM part GROUP BY 1""")
def topic_counts(spark, sf_dir):
    return evidence.topic_counts(table(spark, sf_dir, "part"), {"tools": ["widget", "gizmo"], "red": ["red"]}, "p_name", "p_brand")


@query(r"""WITH t AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) + 1 AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_\x{0900}-\x{097F}]+') AS t FROM documents)),
  a AS (SELECT doc_id, min(i) AS pos FROM t WHERE w = 'the' GROUP BY 1),
  n AS (SELECT t.doc_id, arg_min(w, (abs(i - pos), CASE WHEN i < pos THEN 1 ELSE 0 END, w)) AS word FROM t JOIN a USING (doc_id) WHERE w IN ('and', 'of', 'in') AND abs(i - pos) BETWEEN 1 AND 5 GROUP BY 1)
  SELECT doc_id, word FROM n""")
def nearest_word(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tk.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", evidence.nearest_word(F.col("t"), "the", ["and", "of", "in"]).alias("word")).filter("word IS NOT NULL")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def source_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.lit(1).alias("page"), F.col("event_type").alias("kind"))
    return evidence.source_groups(rows).select(F.col("document_id").alias("user_id"), F.array_join(F.transform("pages", lambda p: p["kind"]), ",").alias("kinds"))
