"""Terminology and form facts: alias joins, registration, first occurrences, field recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.functions import tokens as tk
from docloom.functions.script import romanize_text
from docloom.functions.vectors import embed_text

#: Aliases that may be broadcast, and first words of aliases that may be looked up within a text's tokens; longer lists
#: are joined by shuffle, and meet all n-grams.
BROADCAST_ALIASES, FIRST_WORDS = 200_000, 20_000
#: Words that make a phrase of a relation and not a term.
RELATIONAL = r"(?i)^(?:.*\s)?(?:is|are|was|were|has|have|of which|which|that|है|हैं|था|थे|होता|किया)(?:\s.*)?$"


def valid_term(term: Column) -> Column:
    """1 to 10 words, 100 characters, no sentence punctuation, no relational word."""
    words = F.size(F.split(F.trim(term), r"\s+"))
    return (F.trim(term) != "") & (words <= 10) & (F.length(term) <= 100) & ~term.rlike(r"[.!?।;:]") & ~term.rlike(RELATIONAL)


def alias_lengths(aliases: DataFrame) -> list[int]:
    """The numbers of words that aliases have; [1] without aliases."""
    words = aliases.filter("alias IS NOT NULL").select(F.size(F.split("alias", " ")).alias("n")).distinct()
    return sorted(r["n"] for r in words.collect()) or [1]


def _few(aliases: DataFrame) -> DataFrame:
    return F.broadcast(aliases) if aliases.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES else aliases


def alias_runs(token_column: Column, aliases: DataFrame) -> Column:
    """Runs (start from 0, words, alias) of a text's tokens that may be aliases: those that begin with an alias's first word and have as many words.

    With more than FIRST_WORDS first words, all runs of these lengths.
    """
    firsts = aliases.filter("alias IS NOT NULL").select(F.size(F.split("alias", " ")).alias("n"), F.element_at(F.split("alias", " "), 1).alias("w")).distinct().limit(FIRST_WORDS + 1).collect()
    out = []
    for n in sorted({r["n"] for r in firsts}) if len(firsts) <= FIRST_WORDS else alias_lengths(aliases):
        words = sorted({r["w"] for r in firsts if r["n"] == n})
        starts = F.when(F.size(token_column) >= n, F.sequence(F.lit(1), F.size(token_column) - n + 1)).otherwise(F.array().cast("array<int>"))
        if len(firsts) <= FIRST_WORDS:
            starts = F.filter(starts, _begins(token_column, words))
        out.append(F.transform(starts, _run(token_column, n)))
    return F.concat(*out) if out else F.array().cast("array<struct<start:int,words:int,alias:string>>")


def _begins(token_column: Column, words: list[str]):
    return lambda i: F.get(token_column, i - 1).isin(words)


def _run(token_column: Column, n: int):
    return lambda i: F.struct((i - 1).alias("start"), F.lit(n).alias("words"), F.array_join(F.slice(token_column, i, n), " ").alias("alias"))


def alias_join(texts: DataFrame, aliases: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, alias, key, n): whole-word alias occurrences, by an equi-join on runs of the text's tokens (no theta join).

    Runs that can't be aliases go before anything is exploded. With few aliases the texts don't move, and
    occurrences are counted in each task before any shuffle.
    """
    toks = texts.select(F.col(id_column), tk.tokens(F.col(text)).alias("t"))
    runs = toks.select(id_column, F.explode(F.transform(alias_runs(F.col("t"), aliases), lambda r: r["alias"])).alias("alias"))
    return runs.join(_few(aliases), "alias").groupBy(id_column, "alias", "key").agg(F.count(F.lit(1)).alias("n"))


def longest_matches(texts: DataFrame, aliases: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, start, words, alias, key): greedy left-to-right longest phrases that don't overlap; starts count from 0."""
    toks = texts.select(F.col(id_column), tk.tokens(F.col(text)).alias("t"))
    spans = toks.select(id_column, F.explode(alias_runs(F.col("t"), aliases)).alias("s")).select(id_column, "s.*")
    hits = spans.join(_few(aliases), "alias").groupBy(id_column, "start").agg(F.max_by(F.struct("words", "alias", "key"), F.struct("words", "alias", "key")).alias("m"))
    listed = hits.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("start", "m"))).alias("h"))
    empty = F.struct(F.lit(0).alias("end"), F.slice("h", 1, 0).alias("kept"))
    step = lambda a, x: F.when(x["start"] >= a["end"], F.struct((x["start"] + x["m"]["words"]).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    return listed.select(id_column, F.explode(F.aggregate("h", empty, step)["kept"]).alias("k")).select(id_column, F.col("k.start").alias("start"), F.col("k.m.words").alias("words"), F.col("k.m.alias").alias("alias"), F.col("k.m.key").alias("key"))


def term_rows(occurrences: DataFrame) -> DataFrame:
    """Valid terms by key and document, from occurrences (canonical, category, english, hindi, roman, document_id, chunk_id, context)."""
    key = F.lower(tk.clean(F.col("canonical")))
    named = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    each = occurrences.filter(valid_term(F.col("canonical"))).withColumn("key", key)
    return each.groupBy("key", "document_id").agg(
        F.min("canonical").alias("canonical"), F.min("category").alias("category"), named("english"), named("hindi"), named("roman"), F.count(F.lit(1)).alias("occurrences"),
        F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"), F.slice(F.array_sort(F.collect_set("context")), 1, 5).alias("contexts"),
    )


def merge_terms(rows: DataFrame) -> DataFrame:
    """One record a key from term_rows() of any number of ingests: names united, occurrences summed, documents listed, 5 contexts."""
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return rows.groupBy("key").agg(
        F.min("canonical").alias("canonical"), F.min("category").alias("category"), united("english").alias("english"), united("hindi").alias("hindi"), united("roman").alias("roman"), F.sum("occurrences").alias("occurrences"),
        F.array_sort(F.collect_set("document_id")).alias("document_ids"), united("source_chunk_ids").alias("source_chunk_ids"), F.slice(united("contexts"), 1, 5).alias("contexts"),
    )


def register(occurrences: DataFrame) -> DataFrame:
    """Term records from occurrences: one a key, merged."""
    return merge_terms(term_rows(occurrences))


def of_category(terms: DataFrame, category: str) -> DataFrame:
    """The terms of a category, by canonical name."""
    return terms.filter(F.col("category") == category).orderBy("canonical")


def alias_index(terms: DataFrame) -> DataFrame:
    """(alias, key, category) of every name of every term."""
    names = F.array_distinct(F.transform(F.concat(F.array("canonical"), "english", "hindi", "roman"), lambda a: F.lower(tk.clean(a))))
    return terms.select(F.explode(names).alias("alias"), "key", "category").filter("alias <> ''").distinct()


def concept_map(terms: DataFrame) -> DataFrame:
    return terms.groupBy("category").agg(F.array_sort(F.collect_set("canonical")).alias("terms"))


def first_containing(terms: DataFrame, chunks: DataFrame, term: str = "term", id_column: str = "id", text: str = "text", before: int = 160, after: int = 200) -> DataFrame:
    """(term, id, context): each term's first chunk by id that has it as a run of words, with its surroundings."""
    wanted = terms.select(F.col(term), F.array_join(tk.tokens(F.col(term)), " ").alias("alias")).distinct()
    hits = alias_join(chunks, wanted.select("alias", F.col(term).alias("key")).distinct(), id_column, text)
    first = hits.groupBy(F.col("key").alias(term)).agg(F.min(id_column).alias(id_column))
    found = first.join(chunks.select(id_column, text), id_column)
    at = F.greatest(F.expr(f"locate(lower({term}), lower({text}))"), F.lit(1))
    return found.select(term, id_column, F.substring(F.col(text), F.greatest(at - before, F.lit(1)), F.lit(before + after)).alias("context"))


def heuristic_terms(texts: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, term): acronyms, and runs of 2 to 4 capitalised words."""
    both = F.concat(F.regexp_extract_all(F.col(text), F.lit(r"\b[A-Z]{2,8}\b"), F.lit(0)), F.regexp_extract_all(F.col(text), F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b"), F.lit(0)))
    return texts.select(id_column, F.explode(F.array_distinct(both)).alias("term")).filter(valid_term(F.col("term")))


#: Canonical fields of forms and their anchor texts.
FIELDS = {
    "office_name": "name of the office", "address": "office address full postal address", "phone": "telephone phone number contact", "email": "email address",
    "head": "name and designation of the head of office", "period": "period quarter ending report period",
}
FIELD_THRESHOLD, OVERLAP_WEIGHT, ADDRESS_MARGIN = 0.35, 0.3, 0.12


def recognise_field_text(label: str | None) -> tuple[str | None, float]:
    """(field, score): the best over the label and its Roman form; cosine to each anchor and 0.3 of token overlap.

    Address comes before office_name within 0.12 unless the label says name.
    """
    forms = [f for f in dict.fromkeys([label or "", romanize_text(label)]) if tk.query_tokens(f)]
    if not forms:
        return None, 0.0
    scores: dict[str, float] = {}
    for form in forms:
        v, toks = embed_text(form), set(tk.query_tokens(form))
        for field, anchor in FIELDS.items():
            own = set(tk.query_tokens(anchor))
            overlap = 0.8 * len(toks & own) / len(toks) + 0.2 * len(toks & own) / len(toks | own)
            score = sum(a * b for a, b in zip(v, embed_text(anchor), strict=True)) + OVERLAP_WEIGHT * overlap
            scores[field] = max(scores.get(field, 0.0), score)
    best = max(scores, key=lambda f: (scores[f], f))
    if best == "office_name" and not any("name" in tk.query_tokens(f) for f in forms) and scores["address"] >= scores[best] - ADDRESS_MARGIN:
        best = "address"
    return (best, round(scores[best], 4)) if scores[best] >= FIELD_THRESHOLD else (None, round(scores[best], 4))


def form_pairs(pages: DataFrame, id_columns: tuple[str, ...] = ("document_id", "page_number"), text: str = "text") -> DataFrame:
    """(ids, position, label, value, value_state) of `label : value` lines of pages with 2 pairs, or with one that is numbered."""
    lines = pages.select(*id_columns, F.posexplode(F.split(F.col(text), "\n")).alias("position", "line"))
    pattern = r"^\s*((?:\(?[0-9]+[.)]\s*)?[^:\n]{2,120}?)\s*[:：]\s*(.*?)\s*$"
    pairs = lines.withColumn("label", F.regexp_extract("line", pattern, 1)).filter("label <> ''").withColumn("value", F.regexp_extract("line", pattern, 2))
    w = Window.partitionBy(*id_columns)
    pairs = pairs.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_num", F.max(F.col("label").rlike(r"^\(?[0-9]+[.)]")).over(w)).filter("_n >= 2 OR _num")
    return pairs.select(*id_columns, "position", F.trim(F.regexp_replace("label", r"^\(?[0-9]+[.)]\s*", "")).alias("label"), "value", nb.value_state(F.col("value")).alias("value_state"))


def _recognised(labels: DataFrame) -> DataFrame:
    """(label, field) of distinct labels that name a known field; these alone go through Python."""
    recognise = F.pandas_udf(lambda s: s.map(lambda x: recognise_field_text(x)[0]), "string")
    return labels.select("label").distinct().withColumn("field", recognise("label")).filter("field IS NOT NULL")


def form_facts(pairs: DataFrame) -> DataFrame:
    """Facts of form pairs whose label is a known field; a fact of a field, value and page counts once."""
    out = pairs.join(_recognised(pairs), "label").withColumn("source_type", F.lit("form")).withColumn("confidence", F.lit(0.8))
    return out.dropDuplicates(["document_id", "page_number", "field", "value"])


def cell_facts(cells: DataFrame) -> DataFrame:
    """Facts of table cells (document_id, table_id, row_index, col_index, header, value) under a header that names a known field, with the row's label as context."""
    filled = cells.filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    fields = _recognised(filled.select(F.col("header").alias("label")))
    rows = filled.join(fields, F.col("header") == F.col("label"))
    return rows.select("document_id", F.lit("table").alias("source_type"), F.lit(None).cast("int").alias("page_number"), F.col("row_index").alias("position"), "field", "label", "value", nb.value_state(F.col("value")).alias("value_state"), F.lit(0.7).alias("confidence")).dropDuplicates(["document_id", "field", "value", "position"])


def metadata_facts(documents: DataFrame) -> DataFrame:
    """Facts of document metadata: the report period."""
    rows = documents.filter("report_period IS NOT NULL")
    return rows.select("document_id", F.lit("metadata").alias("source_type"), F.lit(None).cast("int").alias("page_number"), F.lit(0).alias("position"), F.lit("period").alias("field"), F.lit("report period").alias("label"), F.col("report_period").alias("value"), F.lit("present").alias("value_state"), F.lit(1.0).alias("confidence"))


def best_fact(facts: DataFrame, field: str) -> DataFrame:
    """The preferred fact of a field in each document: metadata, then form, then table; with a page first; the earliest."""
    order = [F.when(F.col("source_type") == "metadata", 0).when(F.col("source_type") == "form", 1).otherwise(2), F.col("page_number").isNull(), F.desc("confidence"), "page_number", "position"]
    own = facts.filter((F.col("field") == field) & (F.col("value_state") == "present"))
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).filter("_n = 1").drop("_n")
