"""A stored inverted index with kept statistics, over the texts of documents in the store.

Postings (token, block, text, frequency, length) lie in buckets by token, sorted by block; a block is a fixed share of the
documents. A question reads the postings of its tokens alone. Block maxima (the largest frequency, the shortest
length) bound what a text of a block can score: the best blocks are scored first, their k-th score is the
threshold, and blocks below it are skipped. Tokens with few texts have no maxima, only a mark: their postings are the
bounds. The forward set holds each text's tokens with their frequencies in a row; postings are dealt from it. Statistics (texts, tokens, document frequencies) are sums of differences:
an update adds what its documents count now and takes off what they counted before, which the forward set remembers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import tokens as tk
from docloom.operators import search
from docloom.sources.store import Packed, Store

#: Blocks of documents; blocks that are scored first; documents whose forward rows are looked up by bucket at most.
BLOCKS, SEEDS, FEW = 1024, 8, 1000
#: Words whose postings are one task's to sort, about.
TASK_WORDS = 4_000_000
#: Scores are rounded to 4 places: a block is skipped only if it is below the threshold by more.
MARGIN = 1e-4
#: Tokens with maxima in one update at most (those with more texts than there are blocks; beyond it, those with the most), and the block of a token without.
MOST_MAXIMA, UNBOUNDED = 100_000, -1
#: The token of the row that counts a document's texts and their tokens.
ALL = ""
COUNTS = ("df", "texts", "length")


def _score(f: Column, dl: Column, idf: float | Column, avgdl: float, k1: float, b: float) -> Column:
    f = f.cast("double")
    return F.when(f > 0, F.lit(idf) * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))).otherwise(0.0)


def _counted(texts: DataFrame) -> DataFrame:
    """Forward rows of texts with tokens (toks): its different tokens and their frequencies, counted within the row, joined by blanks."""
    rows = texts.select("document_id", "id", "collection", F.sort_array("toks").alias("s")).withColumn("at", _starts("s", lambda x: x))
    n = F.size("s")
    tokens = F.transform("at", lambda i: F.get("s", i))
    tfs = F.transform("at", lambda i, j: (F.coalesce(F.get("at", j + 1), n) - i).cast("string"))
    return rows.select("document_id", "id", "collection", n.cast("long").alias("length"), F.array_join(tokens, " ").alias("tokens"), F.array_join(tfs, " ").alias("tfs"))


def _starts(column: str, key: Callable[[Column], Column]) -> Column:
    """Places, from 0, where runs of an equal key begin in a sorted array."""
    runs = F.filter(F.sequence(F.lit(0), F.size(column) - 1), lambda i: (i == 0) | (key(F.get(column, i)) != key(F.get(column, i - 1))))
    return F.when(F.size(column) > 0, runs).otherwise(F.array().cast("array<int>"))


def _unjoined(column: str) -> Column:
    """The words of a text that were joined by blanks, which no token has."""
    return F.when(F.col(column) != "", F.split(column, " ")).otherwise(F.array().cast("array<string>"))


def _postings_of(dealt: DataFrame) -> DataFrame:
    """The postings of rows whose tokens are joined."""
    rows = dealt.select("collection", "block", "id", "dl", "document_id", "bucket", F.explode(F.arrays_zip(_unjoined("tokens").alias("token"), _unjoined("tfs").alias("tf"))).alias("t"))
    return rows.select("*", "t.token", "t.tf").drop("t")


def _differences(forward: DataFrame, sign: int) -> DataFrame:
    """(collection, token, df, texts, length) that texts add to the statistics, or take off them."""
    one, zero = F.lit(sign).cast("long"), F.lit(0).cast("long")
    each = forward.select("collection", F.explode("tokens").alias("token"), one.alias("df"), zero.alias("texts"), zero.alias("length"))
    return each.unionByName(forward.select("collection", F.lit(ALL).alias("token"), zero.alias("df"), one.alias("texts"), (F.col("length") * sign).alias("length")))


class TextIndex:
    """The inverted index of a store."""

    def __init__(self, store: Store, blocks: int = BLOCKS) -> None:
        self.store, self.blocks = store, blocks

    def update(self, texts: DataFrame, documents: DataFrame | None = None) -> None:
        """Texts (document_id, id, collection, text) take the place of all texts of their documents, and of `documents` (document_id).

        One version: postings, maxima, forward rows and statistics change together. Again, it changes nothing. Null texts
        count as texts without tokens.
        """
        ids = texts.select("document_id") if documents is None else texts.select("document_id").unionByName(documents.select("document_id"))
        ids = ids.distinct()
        with self.store.transaction():
            before = self._forward(ids)
            texts = texts.select("document_id", "id", "collection", F.coalesce(tk.tokens(F.col("text")), F.array().cast("array<string>")).alias("toks"))
            after = self.store.write("forward", _counted(texts), ids, whole=False, packed=Packed(lambda df: df.withColumns({c: _unjoined(c) for c in ("tokens", "tfs")})))
            words = after.agg(F.sum("length")).first()[0] or 0
            postings = self.store.write("postings", self._dealt(after), ids, whole=False, packed=Packed(_postings_of, math.ceil(words / (TASK_WORDS * self.store.buckets))))
            self.store.append("maxima", self._maxima(postings))
            changed = _differences(after, 1).unionByName(_differences(before, -1))
            sums = changed.groupBy("collection", "token").agg(*[F.sum(c).alias(c) for c in COUNTS])
            self.store.append("statistics", sums.filter(" OR ".join(f"{c} <> 0" for c in COUNTS)))

    def _dealt(self, forward: DataFrame) -> DataFrame:
        """Forward rows cut by the buckets of their tokens: a row for each bucket of a text, its tokens and frequencies joined."""
        each = F.sort_array(F.transform(F.arrays_zip("tokens", "tfs"), lambda t: F.struct(self.store.bucket(t["tokens"]).alias("b"), t["tokens"].alias("t"), t["tfs"].alias("f"))))
        rows = forward.select("document_id", "id", "collection", F.col("length").alias("dl"), each.alias("e")).withColumn("at", _starts("e", lambda e: e["b"]))
        cut = F.transform("at", lambda i, j: F.slice("e", i + 1, F.coalesce(F.get("at", j + 1), F.size("e")) - i))
        rows = rows.select("document_id", "id", "collection", "dl", F.explode(cut).alias("e"))
        block = F.pmod(F.xxhash64("document_id"), F.lit(self.blocks)).cast("int")
        tokens, tfs = F.array_join("e.t", " "), F.array_join(F.col("e.f").cast("array<string>"), " ")
        return rows.select("document_id", "id", "collection", "dl", block.alias("block"), F.get("e", F.lit(0))["b"].alias("bucket"), tokens.alias("tokens"), tfs.alias("tfs"))

    def _maxima(self, postings: DataFrame) -> DataFrame:
        """Maxima of tokens with more texts than there are blocks, which are few; a mark for every other token."""
        counts = postings.groupBy("collection", "token").agg(F.count(F.lit(1)).alias("n"))
        sizes = counts.filter(F.col("n") > self.blocks).groupBy(F.floor(F.log2("n")).alias("power")).count().collect()  # 63 rows at most
        least = self.blocks
        for power in sorted(r["power"] for r in sizes):
            if sum(r["count"] for r in sizes if r["power"] >= power) > MOST_MAXIMA:
                least = 2 ** (power + 1)
        many = F.broadcast(counts.filter(F.col("n") > least).select(F.col("collection").alias("_c"), F.col("token").alias("_t")))  # MOST_MAXIMA rows at most
        per = postings.join(many, F.col("collection").eqNullSafe(F.col("_c")) & (F.col("token") == F.col("_t")), "left_semi")
        per = per.groupBy("collection", "token", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        marks = counts.filter(F.col("n") <= least).select("collection", "token", F.lit(UNBOUNDED).alias("block"), F.lit(0).alias("tf"), F.lit(0).alias("dl"))
        return per.unionByName(marks)

    def remove(self, *document_ids: str) -> None:
        """Take documents out of the index and its statistics."""
        spark = self.store.spark
        ids = spark.createDataFrame([(d,) for d in document_ids], "document_id string")
        self.update(spark.createDataFrame([], "document_id string, id string, collection string, text string"), ids)

    def _forward(self, ids: DataFrame) -> DataFrame:
        few = [r[0] for r in ids.limit(FEW + 1).collect()]
        if len(few) <= FEW and None not in few:
            return self.store.read("forward", few) if few else self.store.read("forward").limit(0)
        rows = self.store.read("forward")
        return rows.alias("f").join(ids.alias("i"), F.col("f.document_id").eqNullSafe(F.col("i.document_id")), "left_semi")

    # -- statistics

    def statistics(self, collection: str | None = None, tokens: list[str] | None = None) -> DataFrame:
        """(term, df, n_docs, avgdl, idf) of every token that a text has, or of some; as a recount of all texts gives them."""
        rows = self.store.read("statistics", [*tokens, ALL] if tokens else None)
        rows = rows if collection is None else rows.filter(F.col("collection") == collection)
        rows = rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS])
        total = rows.filter(F.col("token") == ALL).select(F.col("texts").alias("n_docs"), (F.col("length") / F.col("texts")).alias("avgdl"))
        terms = rows.filter((F.col("token") != ALL) & (F.col("df") > 0)).select(F.col("token").alias("term"), "df")
        return terms.crossJoin(F.broadcast(total)).withColumn("idf", search.idf(F.col("n_docs"), F.col("df")))  # one row

    # -- search

    def _postings(self, name: str, terms: list[str], collection: str | list[str] | None, scope: list[str] | None = None) -> DataFrame:
        rows = self.store.read(name, terms)
        if collection is not None:
            rows = rows.filter(F.col("collection").isin([collection] if isinstance(collection, str) else collection))
        return rows.filter(F.col("document_id").isin(scope)) if scope else rows

    def _top(self, terms: list[str], part: Callable[[str, Column, Column], Column], k: int, collection: str | list[str] | None, scope: list[str] | None, more: float = 0.0, last: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(document_id, id, score) of the k best by the sum of parts over terms; `more` is what `last` may add to a score at most."""
        kept = self._postings("maxima", terms, collection)
        unbounded = [r[0] for r in kept.filter(F.col("block") == UNBOUNDED).select("token").distinct().collect()]  # some of the terms
        top = kept.filter(F.col("block") != UNBOUNDED).select("token", "block", "tf", "dl")
        if unbounded:
            top = top.unionByName(self._postings("postings", unbounded, collection).select("token", "block", "tf", "dl"))
        top = top.groupBy("token", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        each = reduce(lambda c, t: c.when(F.col("token") == t, part(t, F.col("tf"), F.col("dl"))), terms, F.when(F.lit(False), 0.0))
        bounds = {r["block"]: r["bound"] for r in top.groupBy("block").agg(F.sum(each).alias("bound")).collect()}  # a row a block
        rows = self._postings("postings", terms, collection, scope)

        def scored(blocks: list[int]) -> DataFrame:
            own = rows.filter(F.col("block").isin(blocks)).groupBy("document_id", "id").agg(F.min("dl").alias("dl"), *[F.sum(F.when(F.col("token") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
            total = reduce(Column.__add__, [part(t, F.col(f"tf{i}"), F.col("dl")) for i, t in enumerate(terms)], F.lit(0.0))
            return own.select("document_id", "id", total.alias("score"))

        order = sorted(bounds, key=lambda b: (-bounds[b], b))
        kept = order
        if len(order) > SEEDS:
            best = [r[0] for r in scored(order[:SEEDS]).orderBy(F.desc("score")).limit(k).select("score").collect()]
            least = best[-1] - MARGIN if len(best) == k else 0.0
            kept = [b for b in order if bounds[b] + more >= least]
        found = scored(kept)
        found = last(found) if last else found
        return search.top_k(found.withColumn("score", F.round("score", 4)).filter("score > 0"), "score", "id", k)

    def bm25(self, query: str, k: int = search.TOP_K, collection: str | list[str] | None = None, scope: list[str] | None = None, phrases: DataFrame | None = None, k1: float = search.BM25_K1, b: float = search.BM25_B) -> DataFrame:
        """(document_id, id, score): search.bm25() over the texts of a collection, with its statistics; scope restricts the result alone.

        phrases: the texts (id, text), for the boost of the whole question; they meet candidates alone.
        """
        terms = list(dict.fromkeys(tk.query_tokens(query)))
        counts = {r["token"]: r for r in self._postings("statistics", [*terms, ALL], collection).groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS]).collect()}  # a row a term
        n, length = (counts[ALL]["texts"], counts[ALL]["length"]) if ALL in counts else (0, 0)
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t in terms for d in [counts[t]["df"] if t in counts else 0]}
        live = [t for t in terms if t in counts and counts[t]["df"] > 0]
        boosted = phrases is not None and len(terms) > 1
        if not live:
            return self.store.spark.createDataFrame([], "document_id string, id string, score double")

        def with_phrase(found: DataFrame) -> DataFrame:
            hit = phrases.filter(F.contains(F.lower("text"), F.lit(query.lower()))).select("id", F.lit(search.PHRASE_BOOST).alias("_boost"))
            return found.join(hit, "id", "left").withColumn("score", F.col("score") + F.coalesce("_boost", F.lit(0.0))).drop("_boost")

        return self._top(live, lambda t, f, dl: _score(f, dl, idf[t], length / n, k1, b), k, collection, scope, search.PHRASE_BOOST if boosted else 0.0, with_phrase if boosted else None)

    def sparse(self, query: str, k: int = search.TOP_K, collection: str | list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
        """(document_id, id, score): search.sparse() over the texts of a collection."""
        weights = tk.query_weights(query)
        if not weights:
            return self.store.spark.createDataFrame([], "document_id string, id string, score double")
        return self._top(list(weights), lambda t, f, dl: F.when(f > 0, tk.sublinear(f) * weights[t]).otherwise(0.0), k, collection, scope)
