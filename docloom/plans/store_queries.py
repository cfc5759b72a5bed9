"""Queries over a store that they build of a table: versions, the inverted index, kept statistics, the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.operators.text_index import TextIndex
from docloom.operators.vector_index import VectorIndex
from docloom.plans.registry import ORACLES, query, table
from docloom.plans.search_queries import QUESTION, TOKENS, vector
from docloom.sources.scratch import Scratch
from docloom.sources.store import Store


def _store(spark: SparkSession, name: str, buckets: int = 16) -> Store:
    return Store(spark, Scratch(spark, name).root, buckets)


@query("""WITH o AS (SELECT *, o_custkey = (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 1) AS gone FROM orders)
  SELECT 'c' || o_custkey AS document_id, o_orderkey::INTEGER AS page_number,
         CASE WHEN o_totalprice > 150000 THEN 'large ' || o_orderpriority WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS text
  FROM o WHERE NOT gone AND NOT (o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def store_upserts(spark, sf_dir):
    """Orders as pages of their customers: written, upserted by key twice, customers of a segment written anew without closed orders, one customer deleted; read by merging the deltas."""
    orders = table(spark, sf_dir, "orders").withColumn("document_id", F.concat(F.lit("c"), "o_custkey")).withColumn("page_number", F.col("o_orderkey").cast("int"))
    store = _store(spark, "upserts")
    rows = lambda df, text: df.select("document_id", "page_number", text.alias("text"))
    store.write("pages", rows(orders, F.col("o_orderstatus")))
    store.merge("pages", rows(orders.filter("o_orderstatus = 'O'"), F.lit("open")))
    store.merge("pages", rows(orders.filter("o_totalprice > 150000"), F.concat(F.lit("large "), "o_orderpriority")))
    builders = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("document_id"))
    kept = store.read("pages").join(builders, "document_id", "left_semi").join(orders.filter("o_orderstatus = 'F'").select("document_id", "page_number"), ["document_id", "page_number"], "left_anti")
    store.write("pages", kept, builders)
    store.delete(orders.groupBy("document_id", "o_custkey").count().orderBy(F.desc("count"), "o_custkey").first()["document_id"])
    return store.read("pages").select("document_id", "page_number", "text")


def _texts(docs: DataFrame) -> DataFrame:
    """Documents as texts of one collection; ids order as the numbers do."""
    name = F.lpad(F.col("doc_id").cast("string"), 18, "0")
    return docs.select(name.alias("document_id"), name.alias("id"), F.lit("content").alias("collection"), "text")


@query(ORACLES["bm25_topk"])
def index_bm25_topk(spark, sf_dir):
    texts = _texts(table(spark, sf_dir, "documents"))
    index = TextIndex(_store(spark, "bm25"))
    index.update(texts)
    return index.bm25(QUESTION, collection="content", phrases=texts).select(F.col("id").cast("long").alias("doc_id"), "score")


@query(ORACLES["sparse_topk"])
def index_sparse_topk(spark, sf_dir):
    index = TextIndex(_store(spark, "sparse"))
    index.update(_texts(table(spark, sf_dir, "documents")))
    return index.sparse(f"{QUESTION} the of", collection="content").select(F.col("id").cast("long").alias("doc_id"), "score")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t)
   SELECT term, df, n AS n_docs, round(avgdl, 6) AS avgdl, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf
   FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM t) GROUP BY 1), n""")
def kept_statistics(spark, sf_dir):
    """Statistics after an ingest of other texts, one of the real ones, one of these once more, and the removal of bad documents."""
    docs = table(spark, sf_dir, "documents")
    index = TextIndex(_store(spark, "statistics"))
    index.update(_texts(docs.withColumn("text", F.concat_ws(" ", "source", "lang"))))
    index.update(_texts(docs))
    index.update(_texts(docs.filter("lang <> 'en'")))
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select(F.lpad(F.col("doc_id").cast("string"), 18, "0").alias("document_id"))
    index.update(_texts(docs.limit(0)), bad)
    return index.statistics("content").select("term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


def _cells(spark: SparkSession, sf_dir: str) -> VectorIndex:
    rows = table(spark, sf_dir, "embeddings")
    name = F.lpad(F.col("vec_id").cast("string"), 18, "0")
    index = VectorIndex(_store(spark, "vectors"), "content")
    index.update(rows.select(name.alias("document_id"), name.alias("id"), F.col("embedding").alias("dense")))
    return index


@query("SELECT vec_id, score FROM (" + ORACLES["dense_topk"] + ")")
def index_dense_topk(spark, sf_dir):
    return _cells(spark, sf_dir).search([(vector(spark, sf_dir, 0), 1.0)]).select(F.col("id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


@query(ORACLES["dense_multi_query_max"])
def index_dense_variants(spark, sf_dir):
    from docloom.operators.search import AUXILIARY_SCALE

    variants = [(vector(spark, sf_dir, i), 1.0 if i == 0 else AUXILIARY_SCALE) for i in (0, 1, 2)]
    return _cells(spark, sf_dir).search(variants).select(F.col("id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, as points and as chunks; ids order as the numbers do."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    name = F.lpad(F.col("doc_id").cast("string"), 18, "0")
    return docs.select(name.alias("id"), name.alias("document_id"), F.lit("content").alias("collection"), F.lit(1).alias("page"), "text", F.col("text").alias("hierarchy_path_text"), F.col("embedding").alias("dense"))


def _ranks(found: DataFrame) -> DataFrame:
    rank = lambda i: F.coalesce(F.col(f"rank_{i}"), F.lit(-1)).cast("long").alias(f"rank_{i}")
    return found.select(F.col("id").cast("long").alias("doc_id"), rank(0), rank(1), "rrf_score")


@query(ORACLES["hybrid_search"])
def hierarchy_candidates(spark, sf_dir):
    """Fusion as the engine does it for points, with both lists from stored indexes."""
    points, store = _points(spark, sf_dir), _store(spark, "points")
    index, cells = TextIndex(store), VectorIndex(store, "hierarchical")
    index.update(points.select("document_id", "id", F.lit("hierarchical").alias("collection"), "text"))
    cells.update(points.select("document_id", "id", "dense"))
    queries = [(vector(spark, sf_dir, 0), 1.0)]
    lists = retrieval.Lists(cells.search(queries, 40), index.sparse(QUESTION, 40, "hierarchical"))
    return _ranks(retrieval.hierarchy_candidates(points, queries, QUESTION, 20, lists))


@query(ORACLES["hybrid_search"].replace("ORDER BY s DESC, doc_id LIMIT 40", "ORDER BY s DESC, doc_id LIMIT 20", 1))
def chunk_candidates(spark, sf_dir):
    """Fusion as the engine does it for chunks, by scans."""
    return _ranks(retrieval.chunk_candidates(_points(spark, sf_dir), [(vector(spark, sf_dir, 0), 1.0)], QUESTION, 20, "content"))
