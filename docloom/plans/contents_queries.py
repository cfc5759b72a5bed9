"""Contents, listing, conversation and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import contents
from docloom.plans.registry import query, table
from docloom.sources.store import collection_counts, listing_of
from docloom.streaming import ingest, windows

YEARS = list(range(1995, 2002))
_COUNTS = ", ".join(f'(count(*) FILTER (year(o_orderdate) = {y}))::BIGINT AS "{y}"' for y in YEARS)


@query(f"""SELECT o_orderpriority AS section, grouping(o_orderpriority) = 1 AS is_total, {_COUNTS} FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def section_breakdown(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return contents.breakdown(rows, "o_orderpriority", "year", YEARS)


@query("""SELECT s_name AS author, count(*)::BIGINT AS works FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY works DESC, author LIMIT 15""")
def author_ranking(spark, sf_dir):
    # works are counted by key before the names are looked up, so that the large side is reduced first
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return contents.author_ranking(named.select(F.col("s_name").alias("author"), "n"), count="n")


@query()
def author_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.initcap("p_name").alias("author"), F.col("p_partkey").alias("position"))
    return contents.author_clusters(rows)


@query("""SELECT event_type, min(event_id) AS first_position FROM events WHERE event_type <> 'General' GROUP BY 1""")
def ordered_distinct(spark, sf_dir):
    return contents.ordered_distinct(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE i = CASE WHEN n >= 3 THEN 3 ELSE 1 END""")
def nth_item(spark, sf_dir):
    return contents.nth(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "role")


@query("""SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::INT AS section_item_index FROM conversations""")
def section_index(spark, sf_dir):
    return contents.section_index(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", "section_item_index")


@query("""SELECT q.page AS page, p.url, p.page_id IS NOT NULL AS found FROM (SELECT unnest([3, 17, 100000]) AS page) q LEFT JOIN pages p ON p.page_id = q.page""")
def page_lookup(spark, sf_dir):
    return contents.by_page(table(spark, sf_dir, "pages"), [3, 17, 100000], "page_id").select("page", "url", "found")


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'PROMO'""")
def articles_by_section(spark, sf_dir):
    return contents.in_section(table(spark, sf_dir, "part"), "PROMO", ("p_type",)).select("p_partkey", "p_name", "p_size")


@query(r"""SELECT p_partkey, hits FROM (SELECT p_partkey, (contains(lower(p_name), 'widget')::INT + contains(lower(p_name), 'small')::INT + CASE WHEN list_contains(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_\x{0900}-\x{097F}]+'), 'hot') THEN 2 ELSE 0 END) AS hits FROM part) WHERE hits > 0""")
def topic_hits(spark, sf_dir):
    return contents.topic_hits(table(spark, sf_dir, "part"), "p_name", ["widget", "small", "hot"], "p_partkey").select("p_partkey", "hits")


@query("""SELECT conv_id, arg_max(text, turn) AS last_text, max(turn) AS last_turn FROM conversations WHERE role = 'user' GROUP BY 1""")
def conversation_memory(spark, sf_dir):
    rows = ingest.last_by_conversation(table(spark, sf_dir, "conversations").filter("role = 'user'"), "conv_id", "turn", "text")
    return rows.select("conv_id", F.col("text").alias("last_text"), F.col("turn").alias("last_turn"))


@query("""SELECT DISTINCT user_id FROM events a WHERE event_id % 2 = 0 AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id % 2 = 1)""")
def common_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("edition", F.col("event_id") % 2)
    return contents.common_members(rows, "user_id", "edition", 0, 1)


@query("""SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, l.doc_id IS NOT NULL AS has_meta FROM documents d LEFT JOIN labels l USING (doc_id)""")
def doc_listing(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", "source")
    return listing_of(files, table(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": 0}).select("doc_id", "source", "quality", "toxic", "has_meta")


_ALL = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS collection, count(*)::BIGINT AS n FROM {t}" for t in _ALL))
def collection_stats(spark, sf_dir):
    return collection_counts({t: table(spark, sf_dir, t) for t in _ALL}, "n")


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "1 day", ["event_type"])


@query("""SELECT w AS window_start, event_type, count(*)::BIGINT AS n FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS w FROM events) GROUP BY 1, 2""")
def sliding_counts(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"), "12 hours", "6 hours", ["event_type"])


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(ts) AS session_start, count(*)::BIGINT AS n FROM g GROUP BY user_id, k""")
def session_counts(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "6 hours", ["user_id"])
