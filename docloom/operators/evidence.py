"""Evidence: cell scoring, scored authors, document mentions, early pages, source groups and spans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.functions import script
from docloom.functions import tokens as tk

ACCEPT_CELL, EARLY_PAGES, EARLY_LEAST, SOURCES = 3.0, 8, 5, 12


def cell_scores(cells: DataFrame, queries: list[list[str]], expected: str | None = None, regions: tuple[str, ...] = (), counting: bool = False) -> DataFrame:
    """Adds score to cells (label, value; header or description; regions): the best overlap over the question's variants, type, region and count terms; 3.0 and more are kept."""
    own = [c for c in ("description", "header") if c in cells.columns][0]
    described = tk.tokens(F.concat_ws(" ", own, "label"))
    overlaps = [tk.token_overlap(F.array(*[F.lit(w) for w in q]), described) for q in queries if q]
    score = 12 * (F.greatest(*overlaps) if len(overlaps) > 1 else overlaps[0] if overlaps else F.lit(0.0))
    flags = nb.cell_flags(F.col("value"))
    if counting:
        score = score + F.when(flags["yes_no"] | ~flags["has_digit"], -8.0).otherwise(0.0) + F.when(flags["percent"], -18.0).when(flags["date"], -20.0).when(flags["pure_number"], 6.0).otherwise(0.0)
    wanted = {"PERCENTAGE": ("percent", 15.0, -18.0), "DURATION": ("duration", 15.0, -20.0), "DATE": ("date", 15.0, -18.0)}.get(expected or "")
    if wanted:
        score = score + F.when(flags[wanted[0]], wanted[1]).otherwise(wanted[2])
    if regions and "regions" in cells.columns:
        score = score + F.when(F.arrays_overlap("regions", F.array(*map(F.lit, regions))), 8.0).when(F.size("regions") > 0, -15.0).otherwise(0.0)
    score = score + F.when(F.trim(F.coalesce("value", F.lit(""))) == "", -8.0).otherwise(0.0)
    return cells.withColumn("score", F.round(score, 3)).filter(F.col("score") >= ACCEPT_CELL)


def author_score_text(query: str, name: str) -> float:
    """1 for equal keys, else the mean of each query word's best ratio to a word of the name."""
    q, n = script.person_key_text(query).split(), script.person_key_text(name).split()
    if not q or not n:
        return 0.0
    return 1.0 if q == n else round(sum(max(script.seq_ratio_text(a, b) for b in n) for a in q) / len(q), 4)


author_score = script._mapped("double", author_score_text)


def title_or_author(entries: DataFrame, query: str, least: float = 0.65) -> DataFrame:
    """Entries by the better of author and title scores, rounded to 2 places: all that tie with the best, 0.65 or more."""
    from docloom.operators.search import relative_cut

    authors = entries.select(F.explode("author_list").alias("author")).distinct().withColumn("a", author_score(F.lit(query), F.col("author")))
    by_author = entries.select("article_id", F.explode("author_list").alias("author")).join(authors, "author").groupBy("article_id").agg(F.max("a").alias("a"))
    scored = entries.join(by_author, "article_id", "left").withColumn("score", F.round(F.greatest(F.coalesce("a", F.lit(0.0)), script.title_score(F.lit(query), F.col("title_original"))), 2)).drop("a")
    return relative_cut(scored, "score", 0.0, least)


def mentioned_document(documents: DataFrame, query: str, generic: tuple[str, ...] = ("report", "magazine", "docx", "pdf", "edition")) -> DataFrame:
    """The first document one of whose name's words (over 3 characters, not generic) the query has."""
    low = query.lower()
    words = F.filter(tk.tokens(F.regexp_replace("document_id", "[_.-]", " ")), lambda t: (F.length(t) > 3) & ~t.isin(*generic))
    return documents.filter(F.exists(words, lambda t: F.contains(F.lit(low), t))).orderBy("document_id").limit(1)


def early_pages(found: DataFrame, chunks: DataFrame, k: int, id_column: str = "id") -> DataFrame:
    """With fewer than 5 hits, chunks of the first 8 pages join them at score 0; k at most."""
    few = found.agg((F.count(F.lit(1)) < EARLY_LEAST).alias("few"))
    early = chunks.filter(F.col("page") <= EARLY_PAGES).join(found.select(id_column), id_column, "left_anti").crossJoin(F.broadcast(few)).filter("few").drop("few").withColumn("score", F.lit(0.0))
    return found.unionByName(early, allowMissingColumns=True).orderBy(F.desc("score"), id_column).limit(k)


def source_groups(evidence: DataFrame) -> DataFrame:
    """(document_id, pages): the distinct (page, kind) of each document, in order."""
    return evidence.groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("page", "kind"))).alias("pages"))


def topic_counts(entries: DataFrame, topics: dict[str, list[str]], title: str = "title_original", edition: str = "document_id") -> DataFrame:
    """(edition, a column for each topic): entries whose title has a word of the topic."""
    low = F.lower(F.col(title))
    hit = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w))
    return entries.groupBy(edition).agg(*[F.count_if(hit(words)).alias(name) for name, words in topics.items()])


def nearest_word(token_column: Column, anchor: str, words: list[str], reach: int = 5) -> Column:
    """Of `words` the one nearest to the anchor, within 5 tokens; after it comes before before it."""
    at = F.array_position(token_column, anchor).cast("int")
    start = F.greatest(at - reach, F.lit(1))
    around = F.when(at > 0, F.slice(token_column, start, F.lit(2 * reach + 1)))
    placed = F.transform(around, lambda t, i: F.struct((i + start - at).alias("far"), t.alias("word")))
    near = F.filter(placed, lambda s: s["word"].isin(words) & (F.abs(s["far"]) <= reach) & (s["far"] != 0))
    keyed = F.transform(near, lambda s: F.struct(F.abs(s["far"]).alias("far"), (s["far"] < 0).cast("int").alias("before"), s["word"].alias("word")))
    return F.array_min(keyed)["word"]


def highlight(text: str, phrases: list[str], spans: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Spans to mark: the given ones in order, else every occurrence of a phrase; none overlaps."""
    found = sorted(spans) if spans else [m.span() for m in re.finditer("|".join(re.escape(p) for p in sorted(filter(None, phrases), key=len, reverse=True)) or r"(?!)", text, re.IGNORECASE)]
    out: list[tuple[int, int]] = []
    for s, e in found:
        if e > s and (not out or s >= out[-1][1]):
            out.append((s, e))
    return out


def parse_comparison(text: Column) -> Column:
    """[(name, first, last)] of lines `name: a → b`."""
    lines = F.regexp_extract_all(text, F.lit(r"[^:\n]+:\s*-?[0-9.,]+\s*→\s*-?[0-9.,]+"), F.lit(0))
    pattern = r"^([^:\n]+):\s*(-?[0-9.,]+)\s*→\s*(-?[0-9.,]+)$"
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, pattern, 1)).alias("name"), nb.coerce_number(F.regexp_extract(x, pattern, 2)).alias("first"), nb.coerce_number(F.regexp_extract(x, pattern, 3)).alias("last")))


def chart(wide: DataFrame, label: str, periods: list[str], unit: str = "") -> DataFrame:
    """One row: (type, labels, series, unit) of a comparison."""
    rows = wide.agg(F.array_sort(F.collect_list(F.struct(label, *[F.col(f"`{p}`").cast("double").alias(f"p{i}") for i, p in enumerate(periods)]))).alias("r"))
    series = F.array(*[F.struct(F.lit(str(p)).alias("name"), F.transform("r", _field(f"p{i}")).alias("values")) for i, p in enumerate(periods)])
    return rows.select(F.lit("bar").alias("type"), F.transform("r", _field(label)).alias("labels"), series.alias("series"), F.lit(unit).alias("unit"))


#: Shapes of chart text that charts are read from.
_CHART = "type string, labels array<string>, series array<struct<name:string,values:array<double>>>, unit string"
_SHAPES = "chart string, type string, labels array<string>, categories array<string>, values array<double>, data string, series string, datasets string, rows string, unit string"


def chart_of(text: Column) -> Column:
    """A chart out of JSON text in any of five shapes: series with values; datasets with data; labels and values; rows of label and value; one of these under `chart`. Null for anything else."""
    inner = F.get_json_object(text, "$.chart")
    own = F.from_json(F.coalesce(F.when(F.startswith(F.trim(inner), F.lit("{")), inner), text), _SHAPES)
    labels = F.coalesce(own["labels"], own["categories"])
    series = F.from_json(own["series"], "array<struct<name:string,label:string,values:array<double>,data:array<double>>>")
    sets = F.from_json(own["datasets"], "array<struct<name:string,label:string,values:array<double>,data:array<double>>>")
    rows = F.from_json(F.coalesce(own["rows"], own["data"]), "array<struct<label:string,name:string,value:double>>")
    rows = F.filter(rows, lambda r: r["value"].isNotNull())
    named = lambda s: F.transform(s, lambda x, i: F.struct(F.coalesce(x["name"], x["label"], F.concat(F.lit("Series "), (i + 1).cast("string"))).alias("name"), F.coalesce(x["values"], x["data"]).alias("values")))
    one = lambda v: F.array(F.struct(F.lit("Value").alias("name"), v.alias("values")))
    numbers = F.coalesce(own["values"], F.from_json(own["data"], "array<double>"))
    made = F.when(F.size(series) > 0, named(series)).when(F.size(sets) > 0, named(sets)).when(F.size(rows) > 0, one(F.transform(rows, lambda r: r["value"]))).when(F.size(numbers) > 0, one(numbers))
    axis = F.when(F.size(rows) > 0, F.transform(rows, lambda r: F.coalesce(r["label"], r["name"]))).otherwise(labels)
    return F.when(made.isNotNull(), F.struct(F.coalesce(own["type"], F.lit("bar")).alias("type"), F.coalesce(labels, axis, F.array().cast("array<string>")).alias("labels"), made.alias("series"), F.coalesce(own["unit"], F.lit("")).alias("unit")))


def chart_json(charts: DataFrame) -> DataFrame:
    """(chart): chart rows as JSON text, which chart_of() reads back."""
    return charts.select(F.to_json(F.struct("type", "labels", "series", "unit")).alias("chart"))


def comparison_table(wide: DataFrame, label: str, periods: list[str]) -> DataFrame:
    """(label, values MAP<period, value>, change, change_pct) of a comparison's rows."""
    pairs = [x for p in periods for x in (F.lit(str(p)), F.col(f"`{p}`").cast("double"))]
    return wide.select(F.col(label).alias("label"), F.create_map(*pairs).alias("values"), "change", "change_pct")


def _field(name: str):
    return lambda r: r[name]


def ui_documents(documents: DataFrame, kind: str | None = None, year: int | None = None, text: str = "") -> DataFrame:
    """Documents of a tab, a year and a search text, by year and name."""
    out = documents
    if kind:
        out = out.filter(F.col("document_type") == kind)
    if year:
        out = out.filter(F.col("year") == year)
    if text:
        out = out.filter(F.contains(F.lower("filename"), F.lit(text.lower())))
    return out.orderBy("year", "filename")


def common_type(documents: DataFrame) -> DataFrame:
    """(document_type): the type that all selected documents share, else null."""
    return documents.agg(F.when(F.count_distinct("document_type") == 1, F.max("document_type")).alias("document_type"))


#: What answers an expected type in a text, each shape in order of preference.
SPANS = {
    "DURATION": (r"(?:for\s+)?([0-9]+\s*(?:to\s*[0-9]+\s*)?(?:days?|weeks?|months?|years?|hours?|minutes?|दिन|माह|वर्ष|घंटे?))",),
    "MONETARY": (r"((?:₹|Rs\.?)\s*[0-9][0-9,.]*(?:\s*(?:lakh|crore))?)", r"([0-9][0-9,.]*\s*(?:lakh|crore)?\s*(?:rupees|रुपये|रुपए))"),
    "PERCENTAGE": (r"([0-9]+(?:\.[0-9]+)?\s*(?:%|percent|प्रतिशत))",),
    "DATE": (rf"({nb.DATE})", r"\b([0-9]{1,2}\s+[A-Z][a-z]+,?\s+(?:19|20)[0-9]{2})\b", r"\b([A-Z][a-z]+\s+[0-9]{1,2},\s+(?:19|20)[0-9]{2})\b"),
    "COUNT": (r"\b([0-9][0-9,]*)\s+(?=[a-zऀ-ॿ])", r"\b([0-9][0-9,]*)\b"),
    "PERSON": (r"\b((?:Shri|Smt|Dr|Mr|Mrs|Ms|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"\bby\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"),
    "RECIPIENT": (r"(?:awarded|presented|given|sent|addressed)\s+to\s+((?:[A-Z][\w.]*\s*)+)",),
    "AWARD": (r"\b((?:[A-Z][a-z]+\s+)*(?:Award|Prize|Medal|Shield|Trophy))\b", r"([\u0900-\u097F]+\s+(?:पुरस्कार|सम्मान))"),
    "LOCATION": (r"(?:held|located|situated|organi[sz]ed)\s+(?:in|at)\s+((?:[A-Z][\w.]*[\s,]*)+)", r"\bin\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"),
}


def factual_span(kind: str | None, text: str) -> str | None:
    """What answers an expected type in a text: a duration, amount, percentage, date, count, person, recipient, award or place; None for other types."""
    for shape in SPANS.get(kind or "", ()):
        if m := re.search(shape, text):
            return m[1].strip(" ,")
    return None


def span_kind(question: str, expected: str | None) -> str | None:
    """The span that a question asks for: a place, a recipient or an award by its words, else its expected type."""
    low = question.lower()
    if re.search(r"\bwhere\b|which (?:place|city|venue)|कहाँ|कहां", low):
        return "LOCATION"
    if re.search(r"to whom|who (?:received|was awarded|got)|किसे|किसको", low):
        return "RECIPIENT"
    if re.search(r"which (?:award|prize|medal)|what (?:award|prize)|कौन सा पुरस्कार", low):
        return "AWARD"
    return expected
