"""Retrieval: metadata filters, dense and sparse top-k, BM25, rank fusion.

A question is small and known to the driver: its vector, weights and terms enter plans as literals, so that
scoring is one scan and top-k is TakeOrderedAndProject, without a shuffle of the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import tokens as tk
from docloom.functions.vectors import cosine_to

#: Fixed values of ranking.
RRF_K, BM25_K1, BM25_B, TOP_K = 60, 1.5, 0.75, 20
PHRASE_BOOST, PAGE_BOOST, YEAR_BOOST, FIELD_TF = 3.0, 3.5, 2.0, 3
AUXILIARY_SCALE = 0.7


def metadata_filter(df: DataFrame, scope: list[str] | None = None, **equal) -> DataFrame:
    """A conjunction of equalities: None and document_type "all" don't restrict; a document_id suppresses the scope; integers that can't be cast are ignored."""
    out = df
    for column, value in equal.items():
        if value is None or (column == "document_type" and str(value).lower() == "all"):
            continue
        if column in ("year", "source_page", "page"):
            try:
                value = int(value)
            except (TypeError, ValueError):
                continue
        out = out.filter(F.col(column) == value)
    if scope and equal.get("document_id") is None:
        out = in_scope(out, scope)
    return out


def in_scope(df: DataFrame, scope: list[str] | DataFrame | None, column: str = "document_id") -> DataFrame:
    """Rows of the documents in scope; no scope is everything; a null id is outside any."""
    if scope is None:
        return df
    if isinstance(scope, DataFrame):
        return df.join(scope.select(F.col(scope.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(scope))) if scope else df


def route(df: DataFrame, content_type: str | None = None, collection: str | None = None) -> DataFrame:
    """The collection asked for: index, content, table; "all" and none are every one; `collection` comes before `content_type`."""
    target = collection or content_type
    return df if target in (None, "all") else df.filter(F.col("collection") == target)


def ranked(df: DataFrame, score: str, id_column: str, name: str = "rank") -> DataFrame:
    """Row numbers from 0 by descending score, then id; for the rows of one result."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), F.col(id_column))) - 1)


def top_k(df: DataFrame, score: str, id_column: str, k: int = TOP_K) -> DataFrame:
    return df.orderBy(F.desc(score), F.col(id_column)).limit(k)


def dense(df: DataFrame, query: list[float], vector: str = "embedding", id_column: str = "id", k: int = TOP_K) -> DataFrame:
    """The k nearest rows by cosine, with score."""
    return top_k(df.withColumn("score", cosine_to(F.col(vector), query)), "score", id_column, k)


def dense_variants(df: DataFrame, queries: list[tuple[list[float], float]], vector: str = "embedding", id_column: str = "id", k: int = TOP_K) -> DataFrame:
    """The k best rows by the largest scaled cosine over query variants, with the first variant that has it."""
    scores = [cosine_to(F.col(vector), q) * scale for q, scale in queries]
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("v")) for i, s in enumerate(scores)]))
    df = df.withColumn("best", best).withColumn("score", F.col("best.score")).withColumn("variant", -F.col("best.v"))
    return top_k(df.drop("best"), "score", id_column, k)


def sparse(df: DataFrame, query: str, text: str = "text", id_column: str = "id", k: int = TOP_K) -> DataFrame:
    """The k best rows that share a token, by the dot product of sublinear weights, to 4 places."""
    weights = tk.query_weights(query)
    if not weights:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    toks = tk.tokens(F.col(text))
    df = df.withColumn("toks", F.filter(toks, lambda t: t.isin(list(weights))))
    parts = [F.when((n := tk.tf(F.col("toks"), t)) > 0, tk.sublinear(n) * w).otherwise(0.0) for t, w in weights.items()]
    return top_k(df.filter(F.size("toks") > 0).withColumn("score", F.round(reduce(Column.__add__, parts), 4)).drop("toks"), "score", id_column, k)


def corpus_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, n_docs, avgdl, idf) of every token."""
    toks = df.select(tk.tokens(F.col(text)).alias("toks"))
    totals = toks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("toks")).alias("avgdl"))
    terms = toks.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.crossJoin(F.broadcast(totals)).withColumn("idf", idf(F.col("n_docs"), F.col("df")))  # one row


def idf(n: Column, d: Column) -> Column:
    return F.log(1 + (n - d + 0.5) / (d + 0.5))


def bm25(df: DataFrame, query: str, text: str = "text", id_column: str = "id", k: int = TOP_K, k1: float = BM25_K1, b: float = BM25_B, fields: tuple[str, ...] = (), page: str | None = None, year: str | None = None) -> DataFrame:
    """The k best rows by BM25 over df, with the boosts for a phrase, a page and a year.

    One scan counts the statistics and one scores the rows that contain a term, a year or a page. A term that occurs
    in one of `fields` adds 3 to its frequency.
    """
    terms = list(dict.fromkeys(tk.query_tokens(query)))
    numbers = [t for t in terms if t.isdigit() and len(t) <= 4]
    has = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t)) for t in terms for c in (text, *fields)]
    has += [F.col(c).cast("string").isin(numbers) for c in (page, year) if c and numbers]
    df = df.withColumn("toks", tk.tokens(F.col(text))).withColumn("dl", F.size("toks"))
    counts = [tk.tf(F.col("toks"), t) + sum((F.when(F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t)), FIELD_TF).otherwise(0) for f in fields), F.lit(0)) for t in terms]
    rows = df.withColumn("tf", F.array(*counts)).drop("toks")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))])
    scored = rows.filter(reduce(Column.__or__, has, F.lit(False))).crossJoin(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(terms)):
        f = F.col("tf")[i].cast("double")
        parts.append(F.when(f > 0, idf(F.col("n"), F.col(f"df{i}")) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0))
    score = reduce(Column.__add__, parts, F.lit(0.0))
    if len(terms) > 1:
        score = score + F.when(F.contains(F.lower(F.col(text)), F.lit(query.lower())), PHRASE_BOOST).otherwise(0.0)
    for column, boost in ((page, PAGE_BOOST), (year, YEAR_BOOST)):
        if column and numbers:
            score = score + F.when(F.col(column).cast("string").isin(numbers), boost).otherwise(0.0)
    scored = scored.withColumn("score", F.round(score, 4)).filter("score > 0")
    return top_k(scored.select(*[c for c in df.columns if c not in ("toks", "dl")], "score"), "score", id_column, k)


def keyword_fallback(df: DataFrame, terms: list[str], text: str = "text", id_column: str = "id", k: int = TOP_K) -> DataFrame:
    """The k shortest rows that contain a term."""
    hit = reduce(Column.__or__, [F.contains(F.lower(F.col(text)), F.lit(t.lower())) for t in terms])
    return df.filter(hit).withColumn("length", F.length(text)).orderBy("length", id_column).limit(k)


def or_else(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """The first result, or the fallback where the first is empty (same columns)."""
    none = first.limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))  # one row
    return first.unionByName(fallback.crossJoin(F.broadcast(none)).filter("_none").drop("_none"))


def fuse(lists: list[DataFrame], id_column: str = "id", rank: str = "rank", k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (id, rank from 0): id, rank_0 .. rank_n, rrf_score; ties by the ranks in turn.

    The order uses the score before it is rounded for output.
    """
    tagged = [d.select(id_column, F.lit(i).alias("_list"), F.col(rank).alias("_rank")) for i, d in enumerate(lists)]
    each = reduce(DataFrame.unionByName, tagged)
    ranks = [F.min(F.when(F.col("_list") == i, F.col("_rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    fused = each.groupBy(id_column).agg(*ranks)
    score = reduce(Column.__add__, [F.coalesce(1.0 / (rrf_k + F.col(f"rank_{i}") + 1), F.lit(0.0)) for i in range(len(lists))])
    order = [F.asc_nulls_last(f"rank_{i}") for i in range(len(lists))]
    return fused.withColumn("_s", score).orderBy(F.desc("_s"), *order, id_column).limit(k).withColumn("rrf_score", F.round("_s", 6)).drop("_s")


def hybrid(df: DataFrame, vector: list[float], query: str, id_column: str = "id", k: int = TOP_K, dense_column: str = "embedding", text: str = "text") -> DataFrame:
    """Dense and sparse top 2k, fused to k."""
    d = ranked(dense(df, vector, dense_column, id_column, 2 * k).select(id_column, "score"), "score", id_column)
    s = ranked(sparse(df, query, text, id_column, 2 * k).select(id_column, "score"), "score", id_column)
    return fuse([d, s], id_column, k=k)


def relative_cut(df: DataFrame, score: str, margin: float, least: float = 0.0) -> DataFrame:
    """Rows whose score is within a margin of the best, and `least` at least."""
    top = df.agg(F.max(score).alias("_top"))
    return df.crossJoin(F.broadcast(top)).filter(F.col(score) >= F.greatest(F.lit(least), F.col("_top") - margin)).drop("_top")


def located_pages(lines: DataFrame, terms: list[str], text: str = "text", most: int = 300) -> DataFrame:
    """Pages that contents lines of a document name next to a term, and the page after each: distinct (document_id, page from 1 to `most`)."""
    low = F.lower(F.col(text))
    hit = reduce(Column.__or__, [F.contains(low, F.lit(t.lower())) for t in terms])
    numbers = F.transform(F.regexp_extract_all(F.col(text), F.lit("[0-9]{1,3}"), F.lit(0)), lambda x: x.cast("int"))
    key = [c for c in ("document_id",) if c in lines.columns]
    pages = lines.filter(hit).select(*key, F.explode(numbers).alias("p"))
    return pages.select(*key, F.explode(F.array("p", F.col("p") + 1)).alias("page")).filter((F.col("page") >= 1) & (F.col("page") <= most)).distinct()


def with_located(found: DataFrame, chunks: DataFrame, pages: DataFrame, id_column: str = "id") -> DataFrame:
    """Hits on located pages get 0.20 more (1.0 at most); other chunks of these pages enter at 0.85."""
    on = [c for c in ("document_id", "page") if c in pages.columns]
    near = chunks.join(F.broadcast(pages), on, "left_semi")  # pages of a question: numbers up to 300 of the documents that name it
    kept = found.join(near.select(id_column, F.lit(True).alias("_near")), id_column, "left")
    kept = kept.withColumn("score", F.when(F.col("_near"), F.least(F.lit(1.0), F.col("score") + 0.20)).otherwise(F.col("score"))).drop("_near")
    new = near.join(found.select(id_column), id_column, "left_anti").withColumn("score", F.lit(0.85))
    return kept.unionByName(new, allowMissingColumns=True)


def structural_union(top: DataFrame, candidates: DataFrame, id_column: str = "id", state: str = "state") -> DataFrame:
    """The top rows, and every VALID candidate that isn't among them."""
    extra = candidates.filter(F.col(state) == "VALID").join(top.select(id_column), id_column, "left_anti")
    return top.unionByName(extra, allowMissingColumns=True)
