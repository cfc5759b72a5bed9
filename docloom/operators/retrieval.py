"""Retrieval over chunks and over hierarchy points: variants, located pages, fusion, structural union and branches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import tokens as tk
from docloom.operators import evidence, search, structure

#: Children of a branch that come in, and rows after re-ranking: for a question that lists, and for others.
EXPAND, RERANK = {True: 100, False: 12}, {True: 25, False: 8}
FULL_SCAN_SCORE, HIERARCHY_K = 0.70, 35

Queries = list[tuple[list[float], float]]


@dataclass(frozen=True)
class Lists:
    """A dense and a sparse list (id, score) that stored indexes have found; None: by a scan."""

    dense: DataFrame | None = None
    sparse: DataFrame | None = None


def _fused(dense: DataFrame, rows: DataFrame, terms: str, text: str, k: int, sparse: DataFrame | None = None) -> DataFrame:
    """Rows of a dense list (id, score) and their sparse list, fused: vector_sim, lexical_score and rrf_score beside rows' columns."""
    sparse = search.sparse(rows, terms, text, "id", 2 * k) if sparse is None else sparse
    lists = [search.ranked(dense.select("id", "score"), "score", "id"), search.ranked(sparse.select("id", "score"), "score", "id")]
    fused = search.fuse(lists, k=k)
    out = fused.join(lists[0].select("id", F.col("score").alias("vector_sim")), "id", "left").join(lists[1].select("id", F.col("score").alias("lexical_score")), "id", "left")
    out = out.join(rows, "id")
    words = list(dict.fromkeys(tk.query_tokens(terms)))
    return out.withColumn("vector_sim", F.coalesce("vector_sim", F.lit(0.0))).withColumn("lexical_score", F.coalesce("lexical_score", tk.lexical_score(F.col(text), words)))


def hierarchy_candidates(points: DataFrame, queries: Queries, terms: str, k: int = HIERARCHY_K, lists: Lists = Lists()) -> DataFrame:
    """The k best points by fusion of the dense list over all variants and the sparse one."""
    dense = search.dense_variants(points, queries, "dense", "id", 2 * k) if lists.dense is None else lists.dense
    return _fused(dense, points, terms, "hierarchy_path_text", k, lists.sparse)


def with_structural(top: DataFrame, points: DataFrame, state: str = "structural_eligibility") -> DataFrame:
    """The candidates, and every VALID point that fusion left out, with no rank."""
    extra = points.select(*[F.col(c) if c in points.columns else F.lit(None).cast(t).alias(c) for c, t in top.dtypes])
    return search.structural_union(top, extra.fillna(0.0, ["vector_sim", "lexical_score"]), "id", state)


def chunk_candidates(chunks: DataFrame, queries: Queries, terms: str, k: int = search.TOP_K, collection: str | None = None, scan: bool = False, words: tuple[str, ...] = (), lists: Lists = Lists()) -> DataFrame:
    """The k best chunks by fusion.

    In the index collection, a listing question (scan) has every chunk at 0.70 at least: those beyond the best k share the
    rank after them. Otherwise few hits are joined by early content pages. Elsewhere, contents lines that name one of
    `words` locate pages, whose chunks come in or rise.
    """
    rows = search.route(chunks, collection=collection)
    dense = search.dense_variants(rows, queries, "dense", "id", k) if lists.dense is None else rows.join(lists.dense.select("id", "score"), "id")
    if collection == "index":
        if scan:
            rest = rows.join(dense.select("id"), "id", "left_anti").withColumn("score", F.lit(FULL_SCAN_SCORE))
            dense = dense.unionByName(search.top_k(rest, "score", "id", k), allowMissingColumns=True)  # more than k chunks are never returned
        content = search.route(chunks, collection="content")
        dense = evidence.early_pages(dense, content, k) if not scan else dense
        rows = rows.unionByName(content.filter(F.col("page") <= evidence.EARLY_PAGES))
    elif words:
        lines = search.route(chunks, collection="index").select("document_id", F.explode(F.split("text", "\n")).alias("text"))
        located = search.located_pages(lines, list(words))
        dense = search.with_located(dense, search.route(rows, collection="content"), located)
    found = _fused(dense, rows, terms, "text", k, lists.sparse)
    return found.filter("vector_sim > 0 OR lexical_score > 0")


def fallback(chunks: DataFrame, terms: str, k: int, collection: str | None, like: DataFrame) -> DataFrame:
    """Where chunk_candidates() finds nothing: the k best by BM25, and where that finds nothing, the shortest chunks with a term; columns as in `like`."""
    rows = search.route(chunks, collection=collection)
    found = search.bm25(rows, terms, "text", "id", k, fields=("section",), page="page", year="year")
    if found.isEmpty():
        found = search.keyword_fallback(rows, list(dict.fromkeys(tk.query_tokens(terms))) or [""], "text", "id", k)
    else:
        found = found.withColumn("lexical_score", F.col("score"))
    return found.select(*[F.col(c).cast(t).alias(c) if c in found.columns else F.lit(0.0 if t == "double" else None).cast(t).alias(c) for c, t in like.dtypes])


def branch_prefixes(evidence_rows: list[dict], listing: bool) -> list[tuple[str, list[str]]]:
    """(document_id, prefix) to expand: branches among the first three rows; for a listing question the parents of leaves too."""
    out: list[tuple[str, list[str]]] = []
    for r in evidence_rows[:3]:
        path = list(r["hierarchy_path"] or [])
        prefix = path if r["node_type"] == "branch" and r["node_value"] is None else path[:-1] if listing and len(path) >= 2 else None
        if prefix and (r["document_id"], prefix) not in out:
            out.append((r["document_id"], prefix))
    return out


def expanded(points: DataFrame, prefixes: list[tuple[str, list[str]]], listing: bool) -> DataFrame:
    """Points below the prefixes, the shallow ones first: 100 of each for a listing question, 12 otherwise."""
    table = points.sparkSession.createDataFrame(prefixes, "document_id string, prefix array<string>")
    below = structure.descendants(points, table)
    nth = F.row_number().over(Window.partitionBy("document_id", "prefix").orderBy("depth", "id"))
    return below.withColumn("_n", nth).filter(F.col("_n") <= EXPAND[listing]).drop("_n", "prefix").dropDuplicates(["id"])


def parents_scored(rows: DataFrame, entities: list[str]) -> DataFrame:
    """(document_id, parent, score) of the parent paths of evidence: 10 for each entity that a child's key names, 2 for each child that describes, and the re-rank scores; the best first."""
    own = rows.withColumn("parent", F.when(F.col("depth") >= 2, F.slice("hierarchy_path", 1, F.col("depth") - 1)).otherwise(F.col("hierarchy_path")))
    toks = tk.tokens(F.col("node_key"))
    matched = sum((F.max(F.array_contains(toks, e.lower()).cast("int")) for e in entities), F.lit(0))
    describes = F.count_if(F.col("node_value").isNotNull() & (F.trim("node_value") != "") & ~F.col("node_value").rlike(r"^[-+]?[0-9]+(?:[,.][0-9]+)?%?$"))
    return own.groupBy("document_id", "parent").agg((10.0 * matched + 2.0 * describes + F.sum("rerank_score")).alias("score")).orderBy(F.desc("score"), "document_id", F.array_join("parent", structure.SEPARATOR))


def child_of_each(points: DataFrame, document_id: str, parent: list[str], entities: dict[str, list[str]]) -> DataFrame:
    """For each entity (with its spellings) the point below a parent whose key names it: one with a value first, then the shallow one. Without entities, one point a key."""
    below = points.filter((F.col("document_id") == document_id) & structure.under(F.col("hierarchy_path"), parent))
    if not entities:
        return structure.first_of(below, ["node_key"], [F.col("node_value").isNull(), "depth", "id"])
    names = F.array(*[F.struct(F.lit(e).alias("entity"), F.array(*[F.lit(s.lower()) for s in spellings]).alias("spellings")) for e, spellings in entities.items()])
    hits = below.withColumn("e", F.explode(names)).filter(F.arrays_overlap(tk.tokens(F.col("node_key")), F.col("e.spellings")))
    return structure.first_of(hits.withColumn("entity", F.col("e.entity")).drop("e"), ["entity"], [F.coalesce(F.trim("node_value"), F.lit("")) == "", "depth", "id"])


def authors_for(chunks: DataFrame, entries: DataFrame, queries: Queries, k: int = search.TOP_K) -> DataFrame:
    """(author_original, first_position): distinct authors of the documents whose index chunks are nearest to a question."""
    from docloom.operators.contents import authors_in

    near = search.dense_variants(search.route(chunks, collection="index"), queries, "dense", "id", k).select("document_id").distinct()
    return authors_in(entries.join(near, "document_id", "left_semi"))
