"""Table, metric and period queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import metrics, tables
from docloom.plans.registry import query, table

_D2 = "DECIMAL(18,2)"


def money(column: str):
    return F.col(column).cast("decimal(18,2)")


@query("""SELECT 'nation' AS table_id, n_nationkey::INT AS row_index, c AS col_index, ['n_nationkey', 'n_name', 'n_regionkey'][c + 1] AS header, [n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR][c + 1] AS value
  FROM nation, (SELECT unnest([0, 1, 2]) AS c)""")
def cells_long(spark, sf_dir):
    return tables.cells_long(table(spark, sf_dir, "nation"), F.lit("nation"), F.col("n_nationkey"), ["n_nationkey", "n_name", "n_regionkey"])


@query("""SELECT o_orderpriority, max(o_totalprice) AS max_amount, min(o_totalprice) AS min_amount, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS max_o_orderkey, arg_max(o_orderkey, (-o_totalprice, -o_orderkey)) AS min_o_orderkey FROM orders GROUP BY 1""")
def table_max_min(spark, sf_dir):
    return tables.extremes(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey", ["o_orderkey"])


@query(f"""SELECT p_type, n, CASE WHEN u <= 1 THEN total END AS total, CASE WHEN u <= 1 THEN round(total / n, 4) END AS average FROM (
  SELECT p_type, count(*)::BIGINT AS n, sum(p_retailprice::{_D2})::DOUBLE AS total, count(DISTINCT CASE WHEN p_type IN ('SMALL', 'LARGE') THEN CASE WHEN p_size > 25 THEN 'km' ELSE 'kg' END ELSE 'rs' END) AS u FROM part GROUP BY 1)""")
def table_avg_unit_guard(spark, sf_dir):
    unit = F.when(F.col("p_type").isin("SMALL", "LARGE"), F.when(F.col("p_size") > 25, "km").otherwise("kg")).otherwise("rs")
    rows = table(spark, sf_dir, "part").select("p_type", money("p_retailprice").alias("amount"), unit.alias("unit"))
    out = tables.guarded_average(rows, "p_type", "amount", "unit")
    return out.select("p_type", "n", F.col("total").cast("double").alias("total"), F.round(F.col("total").cast("double") / F.col("n"), 4).alias("average"))


@query(f"""SELECT o_orderpriority, abs(arg_max(o_totalprice::{_D2}, (o_orderdate, o_orderkey)) - arg_min(o_totalprice::{_D2}, (o_orderdate, o_orderkey)))::DOUBLE AS difference FROM orders GROUP BY 1 HAVING count(*) >= 2""")
def table_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("amount", money("o_totalprice"))
    return tables.difference(rows, "o_orderpriority", "amount", ["o_orderdate", "o_orderkey"]).withColumn("difference", F.col("difference").cast("double"))


@query("""SELECT event_type AS table_id, round(0.45 + 0.35 * avg((f >= 3)::INT::DOUBLE) + 0.15, 4) AS extraction_confidence FROM (
  SELECT event_type, (event_id IS NOT NULL)::INT + 1 + (event_id % 3 <> 0)::INT + (event_id % 5 <> 0)::INT AS f FROM events) GROUP BY 1""")
def table_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("user_id").alias("u"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("p"))
    cells = tables.cells_long(rows, F.col("event_type"), F.col("event_id"), ["event_id", "u", "v", "p"])
    return tables.confidence(cells)


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type = 'signup' AS reset, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events),
  g AS (SELECT *, sum(reset::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM e)
  SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM g""")
def carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return tables.carry_forward(rows, ["user_id"], ["ts", "event_id"], "v", F.col("event_type") == "signup").select("event_id", "carried")


REGIONAL = "FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey"


def regional(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at any size
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("value", money("c_acctbal")).withColumn("is_percent", F.col("c_mktsegment") == "MACHINERY")


@query(f"""SELECT r_name, c_mktsegment, count(DISTINCT n_name)::BIGINT AS n_regions, CASE WHEN NOT bool_or(c_mktsegment = 'MACHINERY') THEN sum(c_acctbal::{_D2})::DOUBLE END AS total, bool_or(c_mktsegment = 'MACHINERY') AS is_percent {REGIONAL} GROUP BY 1, 2 HAVING count(DISTINCT n_name) >= 2""")
def region_total(spark, sf_dir):
    out = metrics.region_totals(regional(spark, sf_dir), ["r_name", "c_mktsegment"], "n_name", "value", "is_percent")
    return out.withColumn("total", F.col("total").cast("double"))


@query(f"""SELECT c_mktsegment, count(*)::BIGINT AS n, CASE WHEN count(*) > 1 THEN sum(c_acctbal::{_D2})::DOUBLE END AS total {REGIONAL} GROUP BY 1""")
def cross_region_total(spark, sf_dir):
    return metrics.group_rollup(regional(spark, sf_dir), ["c_mktsegment"], "value").withColumn("total", F.col("total").cast("double"))


YEARS = list(range(1995, 2002))


@query(f"""SELECT o_orderpriority, {", ".join(f'"{y}"' for y in YEARS)}, round("2001" - "1995", 2) AS change, round(("2001" - "1995") / "1995" * 100, 2) AS change_pct FROM (
  SELECT o_orderpriority, {", ".join(f'''(sum(o_totalprice::{_D2}) FILTER (year(o_orderdate) = {y}))::DOUBLE AS "{y}"''' for y in YEARS)} FROM orders GROUP BY 1)""")
def period_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")).withColumn("value", money("o_totalprice"))
    wide = metrics.pivot_periods(rows, ["o_orderpriority"], "year", "value", YEARS)
    wide = wide.select("o_orderpriority", *[F.col(f"`{y}`").cast("double").alias(str(y)) for y in YEARS])
    out = metrics.compare(wide, YEARS)
    return out.withColumn("change", F.round("change", 2))


@query()
def period_fuzzy_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("section"), F.concat(F.lit("number of "), F.regexp_replace("p_name", "gizmo", "gizmos")).alias("metric_key"), (F.col("p_partkey") % 2).cast("string").alias("period"), F.col("p_partkey").alias("position"))
    firsts = rows.groupBy("section", "metric_key", "period").agg(F.min("position").alias("position"))
    return metrics.fuzzy_merge(firsts, ["section"])


@query("""SELECT o_orderkey FROM orders WHERE (year(o_orderdate), month(o_orderdate)) = (SELECT max((year(o_orderdate), month(o_orderdate))) FROM orders)""")
def latest_period(spark, sf_dir):
    return metrics.latest_period(table(spark, sf_dir, "orders"), F.struct(F.year("o_orderdate"), F.month("o_orderdate"))).select("o_orderkey")


@query(f"""SELECT p_type, p_brand, count(*)::BIGINT AS n, CASE WHEN count(*) > 1 THEN sum(p_retailprice::{_D2})::DOUBLE END AS total FROM part GROUP BY 1, 2""")
def group_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("value", money("p_retailprice"))
    return metrics.group_rollup(rows, ["p_type", "p_brand"], "value").withColumn("total", F.col("total").cast("double"))


@query("""SELECT 'nation:' || CASE WHEN c IS NULL THEN 'summary' ELSE 'r' || c END AS id, CASE WHEN c IS NULL THEN 'summary' ELSE 'row' END AS chunk_type,
  CASE WHEN c IS NULL THEN 'n_nationkey | n_name | n_regionkey (25 rows)' ELSE 'n_nationkey: ' || c || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey END AS text
  FROM (SELECT n_nationkey AS c, n_name, n_regionkey FROM nation UNION ALL SELECT NULL, NULL, NULL)""")
def table_chunks(spark, sf_dir):
    cells = tables.cells_long(table(spark, sf_dir, "nation"), F.lit("nation"), F.col("n_nationkey"), ["n_nationkey", "n_name", "n_regionkey"])
    return tables.table_chunks(cells).select("id", "chunk_type", "text")


@query("""SELECT p_type AS table_id, max(p_retailprice)::DOUBLE AS answer, 'rs' AS unit, arg_max(p_name, (p_retailprice, -p_partkey)) AS label FROM part GROUP BY 1""")
def table_calculate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_type", "p_partkey", F.col("p_name").alias("name"), F.concat(F.format_string("%.2f", "p_retailprice"), F.lit(" rs")).alias("price"))
    cells = tables.cells_long(rows, F.col("p_type"), F.col("p_partkey"), ["name", "price"])
    return tables.calculate(cells, "What is the highest price?").withColumn("answer", F.col("answer").cast("double"))
