"""Hierarchy, eligibility and evidence queries over region > nation > customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.operators import search, structure
from docloom.plans.questions import ATTRIBUTES
from docloom.plans.registry import query, table


def leaves(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at any size
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit("%"))).otherwise(F.col("c_custkey").cast("string"))
    return rows.select(F.lit("d1").alias("document_id"), F.array("r_name", "n_name", "c_name").alias("path"), value.alias("value"))


def points(spark, sf_dir):
    return structure.hierarchy_points(leaves(spark, sf_dir))


POINTS = """l AS (SELECT [r_name, n_name, c_name] AS path, CASE WHEN c_custkey % 4 = 0 THEN c_custkey || '%' ELSE c_custkey::VARCHAR END AS value FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
  b AS (SELECT 'leaf' AS node_type, path, value FROM l UNION ALL SELECT DISTINCT 'branch', path[1:1], NULL FROM l UNION ALL SELECT DISTINCT 'branch', path[1:2], NULL FROM l),
  p AS (SELECT node_type, path, value, array_to_string(path, ' > ') || CASE WHEN value IS NOT NULL THEN ' = ' || value ELSE '' END AS text, len(path) AS depth,
    CASE WHEN node_type = 'branch' THEN 'BRANCH' WHEN value LIKE '%\\%' ESCAPE '\\' THEN 'PERCENTAGE' ELSE 'NUMERIC' END AS value_type FROM b)"""


@query(f"""WITH {POINTS} SELECT 'd1::hier::' || node_type || '::' || text AS id, sha256('["d1","' || text || '"]') AS record_id, value_type, path[1] AS root_section, path[len(path) - 1] AS parent_key, depth::INT AS depth FROM p""")
def hierarchy_points(spark, sf_dir):
    return points(spark, sf_dir).select("id", nb.record_id(F.col("document_id"), F.col("hierarchy_path_text")).alias("record_id"), "value_type", "root_section", "parent_key", "depth")


@query(f"""WITH {POINTS} SELECT 'd1::hier::' || node_type || '::' || text AS id, depth::INT AS depth FROM p WHERE (path[1:1] = ['ASIA'] AND depth > 1) OR (path[1:2] = ['EUROPE', 'NATION_3'] AND depth > 2)""")
def path_prefix(spark, sf_dir):
    prefixes = spark.range(1).select(F.lit("d1").alias("document_id"), F.explode(F.array(F.array(F.lit("ASIA")), F.array(F.lit("EUROPE"), F.lit("NATION_3")))).alias("prefix"))
    return structure.descendants(points(spark, sf_dir), prefixes).select("id", "depth")


@query(f"""WITH {POINTS} SELECT path[2] AS child, count(*)::BIGINT AS n_nodes, (count(*) FILTER (node_type = 'leaf'))::BIGINT AS n_leaves FROM p WHERE path[1] = 'ASIA' AND depth > 1 GROUP BY 1""")
def branch_summary(spark, sf_dir):
    return structure.branch_summary(points(spark, sf_dir), ["ASIA"]).select("child", "n_nodes", "n_leaves")


@query(f"""WITH {POINTS} SELECT path[2] AS parent_key, round(10 * (max(contains(lower(path[3]), '#000000001')::INT) + max(contains(lower(path[3]), '7')::INT)) + 0.25 * count(*), 4) AS score FROM p WHERE node_type = 'leaf' GROUP BY 1""")
def best_parent(spark, sf_dir):
    children = points(spark, sf_dir).filter("node_type = 'leaf'").withColumn("rerank_score", F.lit(0.25))
    return structure.best_parent(children, ["#000000001", "7"]).select("parent_key", F.round("score", 4).alias("score"))


@query("""SELECT c_custkey, CASE WHEN both IS NULL THEN 'UNKNOWN' WHEN both THEN 'VALID' ELSE 'CONTRADICTED' END AS state FROM (
  SELECT c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(c_mktsegment) IN ('machinery', 'building') END) AND (CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal > 0 END)
    AND (CASE WHEN c_custkey % 7 <> 0 THEN true END) AS both FROM customer)""".replace("both", "b3"))
def tri_state_match(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    segment = structure.slot(["MACHINERY", "BUILDING"], F.array(F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))))
    kind = structure.type_slot("COUNT", F.when(F.col("c_custkey") % 5 != 0, F.when(F.col("c_acctbal") > 0, "NUMERIC").otherwise("TEXT")))
    value = F.when(F.col("c_custkey") % 7 != 0, F.col("c_name"))
    return rows.select("c_custkey", structure.eligibility([segment, kind, None], F.lit(True), value).alias("state"))


@query("""WITH c AS (SELECT c_custkey AS id, c_acctbal AS score, CASE WHEN c_mktsegment = 'BUILDING' THEN 'VALID' ELSE 'UNKNOWN' END AS state FROM customer),
  t AS (SELECT * FROM c ORDER BY score DESC, id LIMIT 20) SELECT id, score, state FROM t UNION ALL SELECT id, score, state FROM c WHERE state = 'VALID' AND id NOT IN (SELECT id FROM t)""")
def structural_union(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.when(F.col("c_mktsegment") == "BUILDING", "VALID").otherwise("UNKNOWN").alias("state"))
    return search.structural_union(search.top_k(rows, "score", "id"), rows)


@query("""SELECT l_orderkey, l_returnflag, l_extendedprice, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey, l_shipdate) AS n FROM lineitem) WHERE n = 1""")
def evidence_dedup(spark, sf_dir):
    order = [F.desc("l_extendedprice"), "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate"]
    return structure.first_of(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], order).select("l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber")


@query("""SELECT s_suppkey, node_key, CASE WHEN lower(n_name) <> 'germany' AND replace(lower(n_name), ' ', '') <> 'germany' THEN 'CONTRADICTED'
    WHEN lower(r_name) <> 'europe' THEN 'CONTRADICTED' WHEN node_key <> 'Telephone' THEN 'CONTRADICTED' WHEN trim(v) = '' THEN 'UNKNOWN' ELSE 'VALID' END AS state
  FROM (SELECT *, unnest(['Telephone', 'Number']) AS node_key, unnest([s_name, s_suppkey::VARCHAR]) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def label_slots(spark, sf_dir):
    """Two points of each supplier (its region as section, its nation as row) against a question for the phone of Germany in Europe."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fields = F.array(F.struct(F.lit("Telephone").alias("k"), F.col("s_name").alias("v")), F.struct(F.lit("Number").alias("k"), F.col("s_suppkey").cast("string").alias("v")))
    points = rows.withColumn("f", F.explode(fields)).select("s_suppkey", F.col("f.k").alias("node_key"), F.col("f.v").alias("node_value"), F.lit("leaf").alias("node_type"), F.col("n_name").alias("row_entity"), F.col("n_name").alias("parent_key"), F.col("r_name").alias("root_section"), F.array("r_name", "n_name", "f.k").alias("hierarchy_path"))
    states = structure.slot_states(structure.Slots(field="phone", entity="Germany", section="Europe"), ATTRIBUTES)
    state = structure.eligibility(states, F.col("node_type") == "leaf", F.col("node_value"))
    return structure.with_labels(points, ATTRIBUTES).select("s_suppkey", "node_key", state.alias("state"))
