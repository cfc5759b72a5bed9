"""Search queries: dense, sparse, BM25, fusion and hybrid."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import tokens as tk
from docloom.functions.vectors import cosine_to
from docloom.operators import search, structure
from docloom.plans.registry import query, table

QUESTION = "the and of that with"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_\x{0900}-\x{097F}]+')"


def vector(spark, sf_dir, vec_id: int) -> list[float]:
    """A question's vector: the one of a stored row, as no sentence model is at hand."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"""SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM (
  SELECT e.vec_id, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY score DESC, vec_id LIMIT 20""")
def dense_topk(spark, sf_dir):
    found = search.dense(table(spark, sf_dir, "embeddings"), vector(spark, sf_dir, 0), id_column="vec_id")
    return search.ranked(found, "score", "vec_id").select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
  WHERE e.label = 3 ORDER BY {COSINE} DESC, e.vec_id LIMIT 20""")
def dense_topk_filtered(spark, sf_dir):
    rows = search.metadata_filter(table(spark, sf_dir, "embeddings"), label=3, document_type=None)
    return search.dense(rows, vector(spark, sf_dir, 0), id_column="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT vec_id, round(max(s), 6) AS score FROM (
  SELECT e.vec_id, {COSINE} * CASE WHEN q.vec_id = 0 THEN 1.0 ELSE 0.7 END AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2)) q)
  GROUP BY vec_id ORDER BY max(s) DESC, vec_id LIMIT 20""")
def dense_multi_query_max(spark, sf_dir):
    variants = [(vector(spark, sf_dir, i), 1.0 if i == 0 else search.AUXILIARY_SCALE) for i in (0, 1, 2)]
    return search.dense_variants(table(spark, sf_dir, "embeddings"), variants, id_column="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
  WHERE e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY {COSINE} DESC, e.vec_id LIMIT 20""")
def dense_scoped(spark, sf_dir):
    scope = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    rows = search.in_scope(table(spark, sf_dir, "embeddings"), scope, "vec_id")
    return search.dense(rows, vector(spark, sf_dir, 0), id_column="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT doc_id, token, count(*)::BIGINT AS tf, round(1 + ln(count(*)), 4) AS weight
  FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY 1, 2""")
def token_tf_weights(spark, sf_dir):
    toks = table(spark, sf_dir, "documents").select("doc_id", F.explode(tk.tokens(F.col("text"))).alias("token"))
    return toks.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf")).withColumn("weight", tk.sublinear(F.col("tf")))


@query(f"""WITH q AS (SELECT token, round(1 + ln(count(*)), 4) AS w FROM (SELECT unnest(string_split('{QUESTION} the of', ' ')) AS token) GROUP BY 1),
  d AS (SELECT doc_id, token, round(1 + ln(count(*)), 4) AS w FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY 1, 2)
  SELECT doc_id, round(sum(d.w * q.w), 4) AS score FROM d JOIN q USING (token) GROUP BY 1 ORDER BY round(sum(d.w * q.w), 4) DESC, doc_id LIMIT 20""")
def sparse_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return search.sparse(rows, f"{QUESTION} the of", id_column="doc_id").select("doc_id", "score")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t)
  SELECT term, df, n AS n_docs, round(avgdl, 6) AS avgdl, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf
  FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM t) GROUP BY 1), n""")
def corpus_stats(spark, sf_dir):
    return search.corpus_stats(table(spark, sf_dir, "documents")).select("term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


_TERMS = QUESTION.split()
_BM25 = " + ".join(f"CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(_TERMS)))


@query(f"""WITH t AS (SELECT doc_id, text, {TOKENS} AS t FROM documents),
  f AS (SELECT doc_id, text, len(t) AS dl, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(_TERMS))} FROM t),
  s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(_TERMS)))} FROM f),
  r AS (SELECT doc_id, round({_BM25} + CASE WHEN contains(lower(text), '{QUESTION}') THEN 3.0 ELSE 0 END, 4) AS score FROM f, s)
  SELECT doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), QUESTION, id_column="doc_id").select("doc_id", "score")


def _occurs(t: str) -> str:
    return f"((length(text) - length(replace(lower(text), '{t}', ''))) / {len(t)})::BIGINT"


@query(f"""SELECT doc_id, round({" + ".join(f"CASE WHEN {_occurs(t)} > 0 THEN (1 + ln({_occurs(t)})) * sqrt({len(t)}) ELSE 0 END" for t in ("the", "ing", "heit"))}, 4) AS score FROM documents""")
def lexical_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tk.lexical_score(F.col("text"), ["the", "ing", "heit"]).alias("score"))


def _lists(spark, sf_dir, ids, k=15):
    rows = table(spark, sf_dir, "embeddings")
    return [search.ranked(search.dense(rows, vector(spark, sf_dir, i), id_column="vec_id", k=k).select("vec_id", "score"), "score", "vec_id") for i in ids]


def _list_sql(i: int, k: int = 15) -> str:
    return f"""SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS r FROM (SELECT e.vec_id, {COSINE} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {i}) q) ORDER BY s DESC, vec_id LIMIT {k}"""


def _fuse_sql(ids: tuple[int, ...], k: int = 20) -> str:
    ranks = ", ".join(f"min(CASE WHEN l = {j} THEN r END) AS rank_{j}" for j in range(len(ids)))
    score = " + ".join(f"coalesce(1.0::DOUBLE / (61 + rank_{j}), 0)" for j in range(len(ids)))
    each = " UNION ALL ".join(f"SELECT {j} AS l, * FROM ({_list_sql(i)})" for j, i in enumerate(ids))
    names = ", ".join(f"coalesce(rank_{j}, -1)::BIGINT AS rank_{j}" for j in range(len(ids)))
    order = ", ".join(f"rank_{j} NULLS LAST" for j in range(len(ids)))
    top = f"SELECT *, {score} AS s FROM (SELECT vec_id, {ranks} FROM ({each}) GROUP BY 1) ORDER BY s DESC, {order}, vec_id LIMIT {k}"
    return f"SELECT vec_id, {names}, round(s, 6) AS rrf_score FROM ({top})"


def _fused(df, n: int, id_column: str = "vec_id"):
    """Ranks as numbers, -1 where a list lacks the row."""
    return df.select(id_column, *[F.coalesce(F.col(f"rank_{i}"), F.lit(-1)).cast("long").alias(f"rank_{i}") for i in range(n)], "rrf_score")


@query(_fuse_sql((0, 1)))
def rrf_fuse(spark, sf_dir):
    return _fused(search.fuse(_lists(spark, sf_dir, (0, 1)), "vec_id"), 2)


@query(_fuse_sql((0, 1, 2)))
def rrf_nway(spark, sf_dir):
    return _fused(search.fuse(_lists(spark, sf_dir, (0, 1, 2)), "vec_id"), 3)


HYBRID = f"""WITH j AS (SELECT d.doc_id, d.text, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
  dense AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS r FROM (SELECT e.doc_id, {COSINE} AS s FROM j e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY s DESC, doc_id LIMIT 40),
  toks AS (SELECT doc_id, token, round(1 + ln(count(*)), 4) AS w FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM j) GROUP BY 1, 2),
  sparse AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS r FROM (SELECT doc_id, round(sum(w), 4) AS s FROM toks WHERE token IN ('the', 'and', 'of', 'that', 'with') GROUP BY 1) ORDER BY s DESC, doc_id LIMIT 40),
  f AS (SELECT coalesce(dense.doc_id, sparse.doc_id) AS doc_id, dense.r AS rank_0, sparse.r AS rank_1, dense.s AS vector_sim FROM dense FULL JOIN sparse USING (doc_id)),
  h AS (SELECT *, coalesce(1.0::DOUBLE / (61 + rank_0), 0) + coalesce(1.0::DOUBLE / (61 + rank_1), 0) AS rrf FROM f ORDER BY rrf DESC, rank_0 NULLS LAST, rank_1 NULLS LAST, doc_id LIMIT 20)"""


def hybrid_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return docs, search.hybrid(docs, vector(spark, sf_dir, 0), QUESTION, "doc_id")


@query(HYBRID + " SELECT doc_id, coalesce(rank_0, -1)::BIGINT AS rank_0, coalesce(rank_1, -1)::BIGINT AS rank_1, round(rrf, 6) AS rrf_score FROM h")
def hybrid_search(spark, sf_dir):
    _, fused = hybrid_rows(spark, sf_dir)
    return _fused(fused, 2, "doc_id")


_RERANK = f"""round(0.75 * coalesce(list_cosine_similarity(j.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0) + least(0.35, 4 * round(rrf, 6)) + 0.15 * least(1.0, lex / 10)
  + 0.20 * len(list_intersect(list_distinct({TOKENS}), ['the', 'and', 'of', 'that', 'with'])) / 5.0, 4)"""
_LEX = " + ".join(f"CASE WHEN {_occurs(t)} > 0 THEN (1 + ln({_occurs(t)})) * sqrt({len(t)}) ELSE 0 END" for t in _TERMS)


@query(HYBRID + f""", x AS (SELECT doc_id, text, embedding, round({_LEX}, 4) AS lex FROM j)
  SELECT doc_id, score, state FROM (
    SELECT j.doc_id, {_RERANK} AS score, CASE WHEN d.lang IS NULL THEN 'UNKNOWN' WHEN d.lang IN ('en', 'de') THEN 'VALID' ELSE 'CONTRADICTED' END AS state
    FROM h JOIN x j USING (doc_id) JOIN documents d USING (doc_id), (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
  WHERE state <> 'CONTRADICTED' ORDER BY CASE WHEN state = 'VALID' THEN 0 ELSE 1 END, score DESC, doc_id LIMIT 5""".replace("lower(text)", "lower(j.text)").replace("length(text)", "length(j.text)").replace("(SELECT doc_id, text, embedding, round(", "(SELECT j.doc_id, j.text, j.embedding, round(").replace("FROM j)\n", "FROM j)\n"))
def rerank(spark, sf_dir):
    docs, fused = hybrid_rows(spark, sf_dir)
    rows = fused.join(docs, "doc_id")
    lexical = tk.lexical_score(F.col("text"), _TERMS)
    score = structure.rerank_score(QUESTION, F.col("text"), cosine_to(F.col("embedding"), vector(spark, sf_dir, 0)), F.col("rrf_score"), lexical)
    state = structure.eligibility([structure.slot(["en", "de"], F.array("lang"))])
    rows = rows.select("doc_id", score.alias("score"), state.alias("state"))
    return structure.rerank(rows, "score", "state", "doc_id")


@query("""SELECT doc_id, length(text)::BIGINT AS length FROM documents WHERE contains(lower(text), 'heit') OR contains(lower(text), 'tion') ORDER BY length(text), doc_id LIMIT 20""")
def keyword_fallback(spark, sf_dir):
    return search.keyword_fallback(table(spark, sf_dir, "documents"), ["heit", "tion"], id_column="doc_id").select("doc_id", F.col("length").cast("long").alias("length"))


@query(f"""SELECT vec_id, round(score, 6) AS score FROM (SELECT *, max(score) OVER () AS top FROM (
  SELECT e.vec_id, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.vec_id <> 1)) WHERE score >= greatest(0.0, top - 0.15)""")
def relative_cut(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter("vec_id <> 1").withColumn("score", cosine_to(F.col("embedding"), vector(spark, sf_dir, 1)))
    return search.relative_cut(rows, "score", 0.15).select("vec_id", F.round("score", 6).alias("score"))


_Q = "(SELECT vec_id AS q, embedding FROM embeddings WHERE vec_id % 100 = 0)"


@query(f"""WITH s AS (SELECT q.q, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, {_Q} q WHERE e.vec_id <> q.q),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS n, lead(score) OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS second FROM s)
  SELECT q, vec_id, round(score, 6) AS score, round(second, 6) AS second FROM r WHERE n = 1 AND score >= 0.2 AND score - coalesce(second, 0) >= 0.005""")
def margin_resolution(spark, sf_dir):
    from docloom.operators.contents import with_margin
    from docloom.operators.nearest import nearest_each

    rows = table(spark, sf_dir, "embeddings")
    questions = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))  # the stated set of questions: a hundredth of the rows
    scored = nearest_each(rows, questions, 2)  # what the margin compares
    return with_margin(scored, "q", "score", "vec_id", 0.2, 0.005).select("q", "vec_id", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"))
