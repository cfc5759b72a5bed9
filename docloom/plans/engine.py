"""The engine: ingest, listing and questions over the store.

ask() is a cascade with early exit: report metrics, contents metrics, exact contents lookups, hierarchy, other
contents questions, form facts, table cells, then text chunks. Plans run on the cluster; only the few rows of an
answer are collected.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.functions import script
from docloom.functions import tokens as tk
from docloom.functions.vectors import embed, embed_text
from docloom.operators import builders, cells, contents, evidence, metrics, pages, report_scores, retrieval, search, structure, tables, terms
from docloom.operators.text_index import TextIndex
from docloom.operators.vector_index import VectorIndex
from docloom.plans.questions import ATTRIBUTES, STOP, Analysis, analyze, expanded_queries
from docloom.sources.store import MOST_DELTAS, SCHEMAS, Store

#: Questions that contents answer before the hierarchy is asked: all that name what they want of them. A count of poems is
#: no number found next to the word.
EXACT = ("AUTHOR_BY_TITLE", "PAGE_BY_TITLE", "ARTICLE_BY_PAGE", "TITLE_BY_AUTHOR", "FIRST_ITEM", "LAST_ITEM", "NTH_ITEM", "COUNT", "EXISTS", "TOPIC_SEARCH", "ARTICLES_BY_SECTION")
#: Words that refer to the article of a conversation's last answer, and what may be asked of it; how long it is remembered.
REFERS = r"\b(?:its?|(?:this|that|the same) (?:article|poem|story|item|piece|title|one))\b|(?:इस|उस)(?:का|के|की|ने)(?!\S)|(?:इस|उस|यह|वह) (?:लेख|कविता|कहानी|रचना)|\b(?:iska|iske|iski|uska|uske|uski|(?:is|us|yah|vah) (?:lekh|kavita|kahani))\b"
FOLLOWED = {
    "author_original": r"author|writer|who wrote|written by|लेखक|किसने|lekhak|kisne", "page_number": r"\bpage\b|पृष्ठ|prishth", "section_original": r"section|खंड|अनुभाग", "title_original": r"title|called|शीर्षक|shirshak",
}
REMEMBERED_S = 30 * 60.0
#: Attributes that are fields of records, not types of values.
FIELDS = ("author", "phone", "email", "address")
#: Collections of the stored indexes.
HIERARCHY, CHUNKS = "hierarchical", ("index", "content", "table")
TABLE_WORDS = r"table|तालिका|विवरण|संख्या|प्रतिशत|quarter|report|तिमाही|लक्ष्य|उपलब्धि|पत्र|बैठक|कार्यशाला|समिति"


@dataclass
class Answer:
    """A text, where it came from, and its evidence rows."""

    text: str
    stage: str
    evidence: list[dict[str, Any]] = field(default_factory=list)
    confidence: int = 100
    table: list[dict[str, Any]] = field(default_factory=list)
    chart: dict[str, Any] | None = None

    def response(self, conversation_id: str | None = None) -> dict[str, Any]:
        """What a client gets: answer, stage, confidence, up to 12 sources (document, page, section, text), table and chart."""
        sources, seen = [], set()
        for r in self.evidence:
            page = next((r[k] for k in ("page", "page_number", "toc_page", "source_page") if r.get(k) is not None), None)
            text = next((str(r[k]) for k in ("text", "display", "hierarchy_path_text", "title_original", "metric", "label") if r.get(k)), "")
            key = (r.get("document_id"), page, r.get("section_no"), r.get("region"), text)
            if key not in seen:
                seen.add(key)
                sources.append({"document_id": r.get("document_id"), "page": page, "section": next((r[k] for k in ("section", "section_original", "root_section") if r.get(k)), None), "text": text})
        return {"conversation_id": conversation_id, "answer": self.text, "stage": self.stage, "confidence": self.confidence, "sources": sources[: evidence.SOURCES], "table": self.table, "chart": self.chart}

    def json(self, conversation_id: str | None = None) -> str:
        return json.dumps(self.response(conversation_id), ensure_ascii=False, default=str)


def _number(x: float | None) -> str:
    return "—" if x is None else f"{x:.2f}".rstrip("0").rstrip(".")


class Engine:
    """Questions over a store.

    Seams with offline defaults: embedder (text to vector of 384), generator (question and evidence to text),
    transliterate (text to the other script), translate (a title to titles in the other language). topics are named
    word lists that edition comparisons count. cells: whether ingest keeps a vector index too, which dense search then
    probes by bounds (exact) instead of a scan; the inverted index is always kept. repairs: patterns of misread words and
    what they stand for, applied to page texts after NFKC.
    """

    def __init__(self, spark: SparkSession, root: str, generator: Callable[[str, list[str]], str] | None = None, embedder: Callable[[str], list[float]] | None = None, transliterate: Callable[[str], str] | None = None, translate: Callable[[str], list[str]] | None = None, topics: dict[str, list[str]] | None = None, cells: bool = False, repairs: dict[str, str] | None = None) -> None:
        self.spark, self.store, self.generator = spark, Store(spark, root), generator
        self.index, self.repairs = TextIndex(self.store), repairs
        self.cells = {c: VectorIndex(self.store, c) for c in (*CHUNKS, HIERARCHY)} if cells else {}
        self.embedder, self.transliterate, self.translate, self.topics = embedder, transliterate, translate, topics or {}

    def _embed(self, text: Column) -> Column:
        if self.embedder is None:
            return embed(text)
        own = self.embedder

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda t: [float(x) for x in own(t or "")])

        return run(text)

    def _vector(self, text: str) -> list[float]:
        return (self.embedder or embed_text)(text)

    def _queries(self, a: Analysis) -> retrieval.Queries:
        own = expanded_queries(a)
        if self.transliterate:
            own.append((self.transliterate(a.clean), 1.0))
        return [(self._vector(q), scale) for q, scale in own if q.strip()]

    # -- ingest

    def ingest(self, page_rows: DataFrame, cell_rows: DataFrame | None = None, document_type: str | None = None, matrices: DataFrame | None = None) -> None:
        """Build and write every record set of the documents in pages (document_id, page_number, text), as one version; again is the same.

        Their native tables come as cells (document_id, table_id, row_index, col_index, header, value) or as matrices
        (document_id, table_id, matrix); form blocks and period lines are found in the pages. The indexes change with them.
        """
        with self.store.transaction():
            self._ingest(page_rows, cell_rows, document_type, matrices)

    def _ingest(self, page_rows: DataFrame, cell_rows: DataFrame | None, document_type: str | None, matrices: DataFrame | None) -> None:
        write = self.store.write
        rows = page_rows.filter("text IS NOT NULL").withColumn("text", script.repair(F.col("text"), compose=True, repairs=self.repairs))
        rows = rows.withColumn("location", F.concat(F.lit("Page "), F.col("page_number").cast("string")))
        ids = page_rows.select("document_id").distinct()
        stored = write("pages", pages.segment(rows.select("document_id", "page_number", "location", "text")), ids)
        meta = write("documents", self._metadata(stored, document_type), ids)

        listed, found = builders.extracted_tables(stored, matrices)
        if cell_rows is not None:
            page = F.col("page_number") if "page_number" in cell_rows.columns else F.lit(None).cast("int")
            given = cell_rows.select("document_id", "table_id", "row_index", "col_index", "header", "value")
            own = cell_rows.select("document_id", "table_id", page.alias("page_number"), F.lit("docx_xml").alias("extraction_method")).distinct()
            listed = listed.unionByName(own.join(tables.confidence(given), "table_id"), allowMissingColumns=True)
            found = found.unionByName(given)
        listed, found = write("tables", listed, ids), write("cells", found, ids)
        native = found.join(listed.filter(F.col("extraction_method").isin(*metrics.NATIVE)).select("table_id"), "table_id", "left_semi")

        pairs = terms.form_pairs(stored)
        write("facts", terms.form_facts(pairs).unionByName(terms.cell_facts(native), allowMissingColumns=True).unionByName(terms.metadata_facts(meta), allowMissingColumns=True), ids)
        write("records", metrics.report_records(found, listed, meta).join(meta.select("document_id", F.col("report_period").alias("period")), "document_id"), ids)
        of_cells = contents.toc_from_cells(native)
        lines = builders.lines_of(stored.filter("segment_type = 'index'"))
        of_pages = contents.toc_from_pages(lines).join(of_cells.select("document_id").distinct(), "document_id", "left_anti")
        entries = write("contents", of_cells.unionByName(of_pages, allowMissingColumns=True).withColumn("dense", self._embed(F.col("title_original"))), ids)

        text = [pages.chunk_ids(pages.chunk(stored.filter(F.col("segment_type") == s)), s).select("document_id", "id", F.lit(s).alias("collection"), F.lit("text").alias("chunk_type"), F.col("page_number").alias("page"), pages.heading(F.col("text")).alias("section"), F.col("chunk").alias("text")) for s in ("index", "content")]
        of_tables = tables.table_chunks(found).unionByName(tables.field_chunks(pairs), allowMissingColumns=True).join(listed.select("table_id", "document_id", F.col("page_number").alias("page"), F.col("heading").alias("section")), "table_id")
        chunks = text[0].unionByName(text[1]).unionByName(of_tables.select("document_id", "id", F.lit("table").alias("collection"), "chunk_type", "page", "section", "text"))
        chunks = write("chunks", chunks.join(meta.select("document_id", "document_type", "year"), "document_id").withColumn("dense", self._embed(F.col("text"))), ids)
        leaves = builders.document_leaves(entries.drop("dense"), native, stored, meta)
        points = structure.with_labels(structure.sibling_ordinals(structure.hierarchy_points(leaves)), ATTRIBUTES).join(meta.select("document_id", "document_type", "year", "quarter", "report_period"), "document_id")
        points = write("points", points.withColumn("dense", self._embed(F.col("hierarchy_path_text"))), ids)
        write("terms", self._terms(chunks.filter("collection <> 'table'")), ids)
        both = chunks.select("document_id", "id", "collection", "text").unionByName(points.select("document_id", "id", F.lit(HIERARCHY).alias("collection"), F.col("hierarchy_path_text").alias("text")))
        self.index.update(both, ids)
        for c, cells_of in self.cells.items():
            own = points if c == HIERARCHY else chunks.filter(F.col("collection") == c)
            cells_of.update(own.select("document_id", "id", "dense"), ids)

    def _metadata(self, stored: DataFrame, document_type: str | None) -> DataFrame:
        """Documents with type, year, quarter and period from their first three pages, and totals of all."""
        first = stored.withColumn("nth", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))).filter("nth <= 3")
        year = nb.page_year(F.col("text"))
        front = first.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda p: p["text"]), "\n").alias("front"), F.min(F.when(year.isNotNull(), F.struct("nth", year.alias("year"))))["year"].alias("page_year"))
        totals = pages.totals(stored, "document_id").join(stored.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("total_pages")), "document_id")
        kind = F.lit(document_type) if document_type else pages.document_type(F.concat_ws(" ", "document_id", "front"))
        named = F.concat_ws(" ", "document_id", "front")
        return front.join(totals, "document_id").select(
            "document_id", F.col("document_id").alias("filename"), F.lower(F.try_element_at(F.split("document_id", r"\."), F.lit(-1))).alias("file_type"), kind.alias("document_type"), F.coalesce("page_year", nb.file_year(F.col("document_id"))).alias("year"), nb.quarter(named).alias("quarter"),
            nb.report_period(F.col("document_id"), F.lit(""), F.col("front")).alias("report_period"), "total_pages", "total_words", "total_chars", F.current_timestamp().alias("upload_date"),
        )

    def _terms(self, chunks: DataFrame) -> DataFrame:
        found = terms.heuristic_terms(chunks).join(chunks.select("id", "document_id", "text"), "id")
        names = F.when(F.col("term").rlike(script.DEVANAGARI), F.array("term")).otherwise(F.array().cast("array<string>"))
        named = found.select(F.col("term").alias("canonical"), F.when(F.col("term").rlike("^[A-Z]{2,8}$"), "acronym").otherwise("entity").alias("category"), F.array("term").alias("english"), names.alias("hindi"), F.array(F.lower("term")).alias("roman"), "document_id", F.col("id").alias("chunk_id"), F.substring("text", 1, 360).alias("context"))
        return terms.term_rows(named)

    def delete(self, document_id: str) -> None:
        """Drop a document, and what the indexes hold of it, in one version."""
        with self.store.transaction():
            self.store.delete(document_id)
            self.index.remove(document_id)
            for own in self.cells.values():
                own.remove(document_id)

    def compact(self) -> None:
        """One base for every record set that has deltas; a job for between ingests."""
        for name in SCHEMAS:
            self.store.compact(name)

    # -- looks

    def documents(self, kind: str | None = None, year: int | None = None, text: str = "") -> DataFrame:
        """Documents with defaults, of a type, a year and a search text, by year and name."""
        return evidence.ui_documents(self.store.listing(), kind, year, text)

    def common_type(self, document_ids: list[str]) -> str | None:
        """The type that all the documents share; None where they differ."""
        return evidence.common_type(self.store.listing().filter(F.col("document_id").isin(document_ids))).first()[0]

    def terminology(self, document_id: str | None = None, category: str | None = None) -> DataFrame:
        """Terms over all ingests, of a document or a category."""
        rows = terms.merge_terms(self.store.read("terms"))
        rows = rows.filter(F.array_contains("document_ids", document_id)) if document_id else rows
        return terms.of_category(rows, category) if category else rows

    def concepts(self, text: str) -> DataFrame:
        """(category, terms) of the terms that a text names, by any of their names."""
        named = terms.merge_terms(self.store.read("terms"))
        rows = self.spark.createDataFrame([(0, text)], "id int, text string")
        keys = terms.alias_join(rows, terms.alias_index(named)).select("key").distinct()
        return terms.concept_map(named.join(keys, "key", "left_semi"))

    def facts(self, document_id: str) -> DataFrame:
        return self.store.read("facts", [document_id])

    def hierarchy(self, document_id: str) -> DataFrame:
        return self.store.read("points", [document_id]).drop("dense").orderBy("hierarchy_path_text")

    def hierarchy_points(self, document_id: str, limit: int = 50, node_type: str | None = None) -> DataFrame:
        return self.store.points(document_id, limit, node_type)

    def vector(self, point_id: str) -> list[float] | None:
        return self.store.vector(point_id)

    def stats(self) -> DataFrame:
        return self.store.stats()

    def authors(self, question: str, scope: list[str] | None = None) -> DataFrame:
        """Distinct authors of the documents whose contents pages are nearest to a question."""
        return retrieval.authors_for(self.store.read("chunks", scope), self.store.read("contents", scope), self._queries(analyze(question)))

    def last_article(self, conversation_id: str, within_s: float = REMEMBERED_S) -> str | None:
        """The article that a conversation's last answer was about, however the engine was restarted; none of a conversation idle for longer."""
        rows = self.store.read("conversations", [conversation_id]).filter(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("seen") <= within_s)
        row = rows.orderBy(F.desc("turn")).first()
        return row["article_id"] if row else None

    def _remember(self, conversation_id: str, article_id: str) -> None:
        turn = self.store.read("conversations", [conversation_id]).agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1
        row = self.spark.createDataFrame([(conversation_id, article_id, turn)], "document_id string, article_id string, turn long")
        self.store.merge("conversations", row.withColumn("seen", F.current_timestamp()))
        if self.store.deltas("conversations") > MOST_DELTAS:
            self.store.compact("conversations")

    def _follow_up(self, a: Analysis, article_id: str, scope: list[str] | None) -> Answer | Analysis | None:
        """A question that says `its author` or `that article`: an answer of the article's entry, or the question with its title in place; none where the entry is gone."""
        entry = self.store.read("contents", scope).drop("dense").filter(F.col("article_id") == article_id).first()
        if entry is None:
            return None
        r = entry.asDict()
        for field_, pattern in FOLLOWED.items():
            if re.search(pattern, a.clean.lower()):
                value = r[field_]
                text = f"page {value}" if field_ == "page_number" and value is not None else str(value) if value is not None else "not available"
                return Answer(text, f"follow_up_{field_}", [r])
        return analyze(re.sub(REFERS, f' {r["title_original"]} ', a.query, count=1, flags=re.IGNORECASE))

    # -- report metrics

    def _scored(self, a: Analysis, scope: list[str] | None) -> DataFrame:
        rows = metrics.reports_only(self.store.read("records", scope), self.store.read("documents", scope)).filter("value IS NOT NULL")
        if a.section_no is not None:
            rows = metrics.section_reference(rows, a.section_no, a.clause)
        if a.regions:
            rows = rows.filter(F.col("region").isin(list(a.regions)))
        words = [t for t in a.topic if t not in ("region", "compare", "total", "क्षेत्र", "कुल") and not t.isdigit()]
        return rows.withColumn("score", report_scores.record_score(a.query, words, *map(F.col, ("metric", "section", "region_header", "is_percent"))))

    def region_total(self, question: str, scope: list[str] | None = None) -> DataFrame:
        """(document_id, section_no, metric_key, n_regions, total, is_percent, regions): the best-fitting metric of each document."""
        scored = self._scored(analyze(question), scope)
        keys = ["document_id", "section_no", "metric_key"]
        totals = metrics.region_totals(scored, keys, "region", "value", "is_percent")
        shown = scored.groupBy(*keys).agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("region", "value", "row_index"))).alias("regions"))
        return search.relative_cut(totals.join(shown, keys), "score", 0.0, metrics.THRESHOLD)

    def compare(self, question: str, scope: list[str] | None = None) -> DataFrame:
        """One row a metric with a column for each period, change and change_pct; empty with fewer than two periods.

        Metrics that are spelt alike in different periods are one. For totals without a region, rows of region "all" add
        up the regions; sub-measures of one column group are added up under the group's name.
        """
        a = analyze(question)
        words = [t for t in a.topic if not t.isdigit()]
        scored = metrics.section_scope(metrics.relevance_cut(self._scored(a, scope), wide=len(a.languages) > 1), words or [""])
        found = [r[0] for r in scored.select("period").filter("period IS NOT NULL").distinct().withColumn("k", nb.period_key(F.col("period"))).orderBy("k").collect()]  # the periods of a few records
        exact = [p for p in found if p in a.periods]
        wanted = exact if len(exact) > 1 else [p for p in found if any(y in p for y in a.periods)] if len(a.periods) > 1 else found
        keys = ["section_no", "region", "merged_key", "is_percent"]
        if len(wanted) < 2:
            return scored.select("section_no", "section", "region", "metric_key", "is_percent").limit(0)
        rows = metrics.fuzzy_merge(scored.filter(F.col("period").isin(wanted)), ["section_no", "region"], "metric_key", "period", "row_index")
        names = rows.groupBy(*keys).agg(F.min("metric").alias("metric"), F.min("section").alias("section"))
        plain = rows.filter("NOT is_percent")
        extra = []
        if a.aggregation == "TOTAL" and not a.regions:
            sums = metrics.group_rollup(plain.filter("region IS NOT NULL"), ["section_no", "merged_key", "period"], "value").filter("total IS NOT NULL")
            extra.append(sums.select("section_no", F.lit("all").alias("region"), "merged_key", F.lit(False).alias("is_percent"), "period", F.col("total").alias("value"), F.lit(0).alias("row_index")))
        groups = metrics.group_rollup(plain.filter("aggregation_group IS NOT NULL"), ["section_no", "region", "aggregation_group", "period"], "value").filter("total IS NOT NULL")
        extra.append(groups.select("section_no", "region", F.col("aggregation_group").alias("merged_key"), F.lit(False).alias("is_percent"), "period", F.col("total").alias("value"), F.lit(0).alias("row_index")))
        every = rows.select(*keys, "period", "value", "row_index")
        for e in extra:
            every = every.unionByName(e)
        wide = metrics.pivot_periods(every, keys, "period", "value", wanted, "row_index")
        both = wide.alias("w").join(names.alias("n"), [F.col(f"w.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "left").select("w.*", F.coalesce("n.metric", "w.merged_key").alias("metric"), "n.section").withColumnRenamed("merged_key", "metric_key")
        return metrics.compare(both, wanted, F.col("is_percent"))

    def _report(self, a: Analysis, scope: list[str] | None) -> Answer | None:
        if a.mode != "REPORT_METADATA":
            return None
        if a.comparing:
            wide = self.compare(a.query, scope)
            rows = [r.asDict() for r in wide.limit(60).collect()]
            if not rows:
                return None
            periods = [c for c in wide.columns if c not in ("section_no", "section", "region", "metric_key", "is_percent", "metric", "change", "change_pct")]
            drawn = evidence.chart(wide.withColumn("name", F.concat_ws(" ", "metric", "region")), "name", periods).first().asDict(True)
            return Answer("; ".join(f"{r['metric']} ({r['region'] or '-'}): change {_number(r['change'])}" + (f" ({_number(r['change_pct'])} %)" if r["change_pct"] is not None else "") for r in rows), "report_compare", rows[:12], table=rows, chart=drawn)
        if a.aggregation == "TOTAL" and len(a.regions) != 1:
            rows = [r.asDict(True) for r in self.region_total(a.query, scope).limit(12).collect()]
            if rows:
                return Answer("; ".join(f"{r['document_id']}: {' + '.join(_number(x['value']) for x in r['regions'])}" + (f" = {_number(r['total'])}" if r["total"] is not None else "") for r in rows), "region_total", rows, table=rows)
        rows = metrics.relevance_cut(self._scored(a, scope))
        rows = metrics.latest_period(rows, nb.period_key(F.coalesce("period", F.lit("")))) if not a.periods else rows.filter(F.exists(F.array(*map(F.lit, a.periods)), lambda p: F.contains(F.coalesce("period", F.lit("")), p)))
        found = [r.asDict() for r in structure.first_of(rows, ["document_id", "section_no", "region", "metric_key"], [F.desc("score"), "table_id", "row_index"], evidence.SOURCES).collect()]
        return Answer("; ".join(f"{r['metric']} ({r['region'] or '-'}): {r['raw_value']}" for r in found), "report_lookup", found) if found else None

    # -- contents

    def _contents(self, scope: list[str] | None) -> DataFrame:
        typed = self.store.read("documents", scope).filter("document_type = 'report'").select("document_id")
        return self.store.read("contents", scope).join(typed, "document_id", "left_anti")

    def _clustered(self, rows: DataFrame) -> DataFrame:
        """(document_id, author) of every work, authors by cluster."""
        works = rows.select("document_id", F.explode("author_list").alias("author"), F.col("serial_number").alias("position"))
        return works.join(contents.author_clusters(works), "author").select("document_id", F.col("cluster").alias("author"))

    def _magazine(self, a: Analysis, scope: list[str] | None) -> Answer | None:
        low, rows = a.clean.lower(), self._contents(scope)
        if a.comparing and a.mode == "INDEX_BASED":
            order = F.struct(nb.edition(F.col("document_id")), "document_id")
            ends = rows.agg(F.min_by("document_id", order), F.max_by("document_id", order)).first()
            if ends[0] == ends[1]:
                return None
            editions = list(ends)  # the first and the last; those between are not compared
            rows = rows.filter(F.col("document_id").isin(editions))
            table = [r.asDict() for r in metrics.compare(contents.breakdown(rows, "section_original", "document_id", editions), editions).orderBy("is_total", "section").collect()]
            text = "; ".join(f"{'total' if r['is_total'] else r['section']}: {r[editions[0]]} → {r[editions[-1]]}" for r in table)
            if self.topics:
                counts = {r["document_id"]: r.asDict() for r in evidence.topic_counts(rows, self.topics).collect()}
                text += "".join(f"; {t}: {counts[editions[0]][t]} → {counts[editions[-1]][t]}" for t in self.topics)
            both = [r[0] for r in contents.common_members(self._clustered(rows), "author", "document_id", editions[0], editions[-1]).orderBy("author").limit(15).collect()]
            return Answer(text + (f"; authors of both: {', '.join(both)}" if both else ""), "contents_compare", table[:12], table=table)
        if "author" in low and any(w in low for w in ("most", "each", "every", "rank")):
            top = [r.asDict() for r in contents.author_ranking(self._clustered(rows)).collect()]
            return Answer("; ".join(f"{r['author']}: {r['works']}" for r in top), "author_ranking", top, table=top) if top else None
        if "author" in low and (a.listing or a.counting) and not a.author and not a.target:
            named = contents.authors_in(rows.select("document_id", "serial_number", F.explode("author_list").alias("author_original")))
            if a.counting:
                n = self._clustered(rows).select("author").distinct().count()
                return Answer(str(n), "author_count", [r.asDict() for r in named.limit(5).collect()]) if n else None
            found = [r.asDict() for r in named.limit(30).collect()]
            return Answer("; ".join(r["author_original"] for r in found), "author_list", found) if found else None
        return None

    def _exact(self, a: Analysis, scope: list[str] | None) -> Answer | None:
        return self._index(a, scope) if a.intent in EXACT else None

    def _other(self, a: Analysis, scope: list[str] | None) -> Answer | None:
        return None if a.intent in EXACT else self._index(a, scope)

    def _index(self, a: Analysis, scope: list[str] | None) -> Answer | None:
        """Contents lookups by intent; negative EXISTS and empty page lookups are answers."""
        if a.mode != "INDEX_BASED":
            return None
        rows = self._contents(scope)
        if scope is None:
            named = [r[0] for r in evidence.mentioned_document(rows.select("document_id").distinct(), a.clean).collect()]
            rows = rows.filter(F.col("document_id").isin(named)) if named else rows
        if a.section and a.intent in ("COUNT", "ARTICLES_BY_SECTION", "NTH_ITEM", "FIRST_ITEM", "LAST_ITEM"):
            own = contents.in_section(rows, a.section)
            rows = own if a.intent == "COUNT" or not own.isEmpty() else rows
        line = lambda r: f"{r['title_original']} — {r['author_original'] or 'not available'} (page {r['page_number']})"
        take = lambda df, n=20: [r.asDict() for r in df.drop("dense").limit(n).collect()]
        if a.intent == "COUNT":
            by = [r.asDict() for r in rows.groupBy("section_original").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "section_original").limit(30).collect()]
            n = rows.count()
            return Answer(str(n), "contents_count", take(rows.orderBy("document_id", "serial_number"), 5), table=by) if n else None
        if a.intent in ("FIRST_ITEM", "LAST_ITEM", "NTH_ITEM"):
            found = take(contents.nth(rows, ["document_id"], ["serial_number"], "last" if a.ordinal == "last" else int(a.ordinal)))
        elif a.intent == "ARTICLE_BY_PAGE":
            found = take(contents.by_page(rows, [a.page]).filter("found").drop("page", "found").orderBy("document_id", "serial_number"))
            return Answer("; ".join(map(line, found)) or f"no entry on page {a.page}", "contents_page", found)
        elif a.intent == "TITLE_BY_AUTHOR" and a.author:
            works = contents.works_of(rows, a.author)
            found = take(works.orderBy("document_id", "serial_number"))
            if found and a.counting:
                by = [r.asDict(True) for r in contents.works_by_author(rows, a.author).orderBy(F.desc("works"), "author", "document_id").limit(15).collect()]
                return Answer(str(works.count()), "author_works", found, table=by)
            found = found or take(evidence.title_or_author(rows, a.author).orderBy("document_id", "serial_number"))
        elif a.intent in ("PAGE_BY_TITLE", "AUTHOR_BY_TITLE", "EXISTS") and (a.target or a.intent == "EXISTS"):
            query = a.target or a.clean
            found = contents.resolve_cascade(rows, query, self._vector(query), self._embed, self.translate)
            if a.intent == "EXISTS":
                return Answer("yes" if found else "no", "contents_exists", found)
            if found and a.intent == "PAGE_BY_TITLE":
                return Answer(f"page {found[0]['page_number']}", "contents_page_of", found)
            if found and a.intent == "AUTHOR_BY_TITLE":
                return Answer(found[0]["author_original"] or "not available", "contents_author_of", found)
        elif a.intent == "STRUCTURED_LOOKUP" and a.target:
            found = take(contents.titles_like(rows, a.target))
        elif a.intent == "TOPIC_SEARCH":
            found = take(contents.topic_hits(rows, "title_normalized", list(a.topic), "article_id"))
            found = found or take(rows.filter(contents.topic_groups([[t, *(v for v in a.variants if t in v.split())] for t in a.topic], F.col("title_normalized"))))
        elif a.intent == "ARTICLES_BY_SECTION":
            found = take(rows.orderBy("document_id", "serial_number"))
        else:
            found = []
        return Answer("; ".join(map(line, found)), f"contents_{a.intent.lower()}", found) if found else None

    # -- hierarchy, facts, cells, chunks

    def _reranked(self, a: Analysis, rows: DataFrame, n: int) -> DataFrame:
        """Points with their state and score, contradicted ones out, the best first."""
        words = " ".join(t for t in a.topic if t not in STOP)
        leaf, text = F.col("node_type") == "leaf", F.col("hierarchy_path_text")
        states = [structure.type_slot(a.expected_type, F.col("value_type"))]
        if a.regions:
            states.append(structure.slot(list(a.regions), cells.region_flags(text)))
        number = f"{a.section_no}({a.clause})" if a.clause else a.section_no
        asked = structure.Slots(a.attribute if a.attribute in FIELDS else None, None, str(number) if number is not None else None, a.relation, " ".join(a.condition_languages), " ".join(a.target_languages))
        state = structure.eligibility([*states, *structure.slot_states(asked, ATTRIBUTES)], leaf, F.col("node_value"), a.listing)
        score = structure.rerank_score(words, text, F.col("vector_sim"), F.col("rrf_score"), F.col("lexical_score"), list(a.entities), a.target) + structure.hierarchy_terms(words, F.col("hierarchy_path"), F.col("node_value"), leaf, F.col("value_type"), a.expected_type)
        return structure.rerank(rows.withColumn("structural_eligibility", state).withColumn("rerank_score", F.round(score, 4)), n=n)

    def hierarchy_search(self, question: str, scope: list[str] | None = None, k: int = retrieval.HIERARCHY_K, **filters) -> DataFrame:
        """Points by fusion of dense and sparse search over the question's variants; with an expected type, every point of such a type too."""
        a = analyze(question)
        rows = search.metadata_filter(self.store.read("points", scope), **filters)
        queries, words = self._queries(a), " ".join([a.clean, *a.entities])
        top = retrieval.hierarchy_candidates(rows, queries, words, k, self._stored_lists(queries, words, HIERARCHY, scope, filters, 2 * k))
        typed = structure.type_slot(a.expected_type, F.col("value_type"))
        if typed is None:
            return top
        leaf = F.col("node_type") == "leaf"
        state = structure.eligibility([typed], leaf, F.col("node_value"))
        words = [t for t in a.topic if t not in STOP]
        near = rows.filter(tk.stem_overlap(words, tk.tokens(F.array_join("hierarchy_path", " "))) >= 1) if words else rows
        return retrieval.with_structural(top.withColumn("structural_eligibility", state), near.withColumn("structural_eligibility", state)).drop("structural_eligibility")

    def _stored_lists(self, queries: retrieval.Queries, words: str, collection: str, scope: list[str] | None, filters: dict[str, Any], k: int) -> retrieval.Lists:
        """The dense and the sparse list by the stored indexes; none where a filter asks for what they don't hold."""
        if any(v is not None for v in filters.values()):
            return retrieval.Lists()
        names = list(CHUNKS) if collection == "all" else [collection]
        sparse = self.index.sparse(words, 2 * k, names, scope)
        own = [self.cells[c].search(queries, k, scope=scope) for c in names] if self.cells else []
        dense = search.top_k(reduce(DataFrame.unionByName, own), "score", "id", k) if own else None
        return retrieval.Lists(dense, sparse)

    def _hierarchy(self, a: Analysis, scope: list[str] | None) -> Answer | None:
        """The best leaf of the hierarchy, its branches expanded; a listing question gets the children of the best parent.

        Beside its score, evidence needs half of the question's words in its path: without a trained embedder a score alone says little.
        """
        words = [t for t in a.topic if t not in STOP]
        if not words:
            return None
        points = self.store.read("points", scope)
        first = [r.asDict() for r in self._reranked(a, self.hierarchy_search(a.query, scope), 5).collect()]
        if not first:
            return None
        scores = ("vector_sim", "lexical_score", "rrf_score")
        pool = self.spark.createDataFrame([(r["id"], *(float(r[c] or 0.0) for c in scores)) for r in first], "id string, " + ", ".join(f"{c} double" for c in scores))
        prefixes = retrieval.branch_prefixes(first, a.listing)
        rows = points.filter(F.col("id").isin([r["id"] for r in first]))
        if prefixes:
            rows = rows.unionByName(retrieval.expanded(points, prefixes, a.listing)).dropDuplicates(["id"])
        rows = rows.join(F.broadcast(pool), "id", "left").fillna(0.0, list(scores))  # five rows
        scored = self._reranked(a, rows, retrieval.RERANK[a.listing])
        in_path = tk.stem_overlap(words, tk.tokens(F.array_join("hierarchy_path", " "))) >= max(1, -(-len(words) // 2))
        if a.listing:
            parents = retrieval.parents_scored(scored.filter(in_path), list(a.entities)).limit(1).collect()
            if not parents:
                return None
            spellings = {e: [e, script.devanagarize_text(e), script.romanize_text(e)] for e in a.entities}
            found = [r.asDict() for r in retrieval.child_of_each(points, parents[0]["document_id"], list(parents[0]["parent"]), spellings).drop("dense").orderBy("sibling_ordinal", "id").limit(25).collect()]
            if not found and a.entities:
                found = [r.asDict() for r in retrieval.child_of_each(points, parents[0]["document_id"], list(parents[0]["parent"]), {}).drop("dense").orderBy("sibling_ordinal", "id").limit(25).collect()]
            below = [r.asDict() for r in structure.branch_summary(points.filter(F.col("document_id") == parents[0]["document_id"]), list(parents[0]["parent"])).orderBy("child").limit(30).collect()]
            return Answer("\n".join(r["node_key"] + (f" = {r['node_value']}" if r["node_value"] else "") for r in found), "hierarchy_list", found, table=below) if found else None
        kept = structure.evidence_gate(scored.filter(in_path), a.expected_type is not None)
        roles = structure.roles_in(a.query)
        kept = structure.typed_or_wordy(kept.filter(structure.roles_present(roles, F.col("hierarchy_path_text"))) if roles else kept, a.expected_type)
        found = [r.asDict() for r in kept.drop("dense").orderBy(F.desc("rerank_score"), "id").limit(5).collect()]
        return Answer(f"{found[0]['node_key']}: {found[0]['node_value']}", "hierarchy", found, confidence=max(10, min(100, int(100 * found[0]["rerank_score"])))) if found else None

    def _facts(self, a: Analysis, scope: list[str] | None) -> Answer | None:
        name, _ = terms.recognise_field_text(" ".join(a.topic))
        if a.mode != "FORM_BASED" or name is None:
            return None
        found = [r.asDict() for r in terms.best_fact(self.store.read("facts", scope), name).orderBy("document_id").limit(evidence.SOURCES).collect()]
        return Answer("; ".join(f"{r['label']}: {r['value']}" for r in found), "form_fact", found) if found else None

    def _cells(self, a: Analysis, scope: list[str] | None) -> Answer | None:
        """Arithmetic over a column first; then a cell for each clause, all of one table; then the best cell and its regions."""
        rows = self.store.read("cells", scope)
        op = tables.operation_of(a.clean)
        if op in ("difference", "max", "min", "average", "sum"):
            hit = rows.filter(tk.stem_overlap(list(a.topic), tk.tokens(F.concat_ws(" ", "header", "value"))) > 0).select("table_id").distinct()
            found = [r.asDict() for r in tables.calculate(rows.join(hit, "table_id", "left_semi").drop("document_id"), a.clean).limit(evidence.SOURCES).collect()]
            if found:
                return Answer("; ".join(f"{_number(float(r['answer']))} {r['unit']}".strip() + (f" ({r['label']})" if r["label"] else "") for r in found), f"table_{op}", found)
        if a.expected_type == "DESCRIPTION" or not a.topic:
            return None
        cands = cells.candidates(rows)
        words = lambda text: [t for t in script.token_forms(text) if t not in STOP]
        best = lambda text: [r.asDict() for r in cells.scored(cands, [words(text), *map(words, a.variants)] if text == a.clean else [words(text)], a.expected_type, a.regions, a.counting).limit(100).collect()]
        chosen: list[dict[str, Any]] = []
        clauses = cells.clauses_of(a.clean)
        if len(clauses) >= 2:
            each = [(best(c) or [None])[0] for c in clauses]
            chosen = each if all(each) and len({r["table_id"] for r in each}) == 1 else []
        if not chosen:
            found = best(a.clean)
            if not found or (a.expected_type == "DURATION" and not cells.lasts(found[0]["value"], found[0]["label"])):
                return None
            chosen = cells.picked(found, a.regions)
        own = self.store.read("tables", scope).filter(F.col("table_id") == chosen[0]["table_id"]).select("document_id", "page_number", "heading", "extraction_confidence").first()
        text = cells.display(chosen, a.query)
        summary = {"chunk_id": f"{chosen[0]['table_id']}:summary", "table_id": chosen[0]["table_id"], "chunk_type": "table", "text": text, "score": 1.0, **(own.asDict() if own else {})}
        return Answer(text, "table_cell", [summary, *chosen])

    def retrieve(self, question: str, scope: list[str] | None = None, k: int = search.TOP_K, collection: str | None = None, **filters) -> DataFrame:
        """Hybrid top-k chunks over the question's variants, with contents pages located, and a keyword fallback where both lists are empty."""
        a = analyze(question)
        rows = search.metadata_filter(self.store.read("chunks", scope), **filters)
        if collection is None:
            collection = "index" if a.mode == "INDEX_BASED" else "all" if a.mode in ("REPORT_METADATA", "FORM_BASED") or re.search(TABLE_WORDS, question.lower()) else "content"
        located = tuple(dict.fromkeys([*((a.target,) if a.target else ()), *(e for e in a.entities if len(e) > 3)]))
        queries, words = self._queries(a), " ".join([a.clean, *a.entities])
        lists = self._stored_lists(queries, words, collection, scope, filters, k) if collection != "index" else retrieval.Lists()
        found = retrieval.chunk_candidates(rows, queries, words, k, collection, a.listing or a.counting, located, lists)
        held = found.collect()  # k rows; a plan that is run once
        found = self.spark.createDataFrame(held, found.schema) if held else retrieval.fallback(rows, words, k, collection, found)
        return found.withColumn("lexical", tk.lexical_score(F.col("text"), [t for t in tk.query_tokens(question) if t not in STOP]))

    def _chunks(self, a: Analysis, scope: list[str] | None) -> Answer | None:
        rows = self.retrieve(a.query, scope, collection="all")
        roles = structure.roles_in(a.query)
        rows = rows.filter(structure.roles_present(roles, F.col("text"))) if roles else rows
        score = structure.rerank_score(a.query, F.col("text"), F.lit(0.0), F.col("rrf_score"), F.col("lexical"), list(a.entities))
        top = rows.drop("dense").withColumn("score", score).orderBy(F.desc("score"), "id").limit(5)
        found = [r.asDict() for r in top.collect()]
        if not found or not structure.sufficient(self.spark.createDataFrame([(float(r["score"]), float(r["lexical"])) for r in found], "score double, lexical double")).first()[0]:
            return None
        texts = [r["text"] for r in found if r["lexical"] > 0 or r["score"] >= 0.45]
        if self.generator:
            text = self.generator(a.query, texts)
        else:
            sentence = best_sentence(a.query, texts)
            text = (sentence and evidence.factual_span(evidence.span_kind(a.query, a.expected_type), sentence)) or sentence
        return Answer(text, "chunks", found, confidence=max(10, min(100, int(100 * found[0]["score"])))) if text else None

    def ask(self, question: str, scope: list[str] | None = None, mode: str | None = None, conversation_id: str | None = None) -> Answer:
        """The first stage that has an answer; no scope, and an empty one, are all documents.

        A conversation remembers the article of its last answer: a question that refers to it is about that article.
        """
        a = analyze(question, mode)
        if conversation_id and re.search(REFERS, question, re.IGNORECASE) and (article := self.last_article(conversation_id)):
            found = self._follow_up(a, article, scope or None)
            if isinstance(found, Answer):
                self._remember(conversation_id, article)
                return found
            a = found or a
        for stage in (self._report, self._magazine, self._exact, self._hierarchy, self._other, self._facts, self._cells, self._chunks):
            if answer := stage(a, scope or None):
                article = next((r["article_id"] for r in answer.evidence if r.get("article_id")), None)
                if conversation_id and article:
                    self._remember(conversation_id, article)
                return answer
        return Answer("not found in the documents", "none", confidence=10)


def best_sentence(question: str, texts: list[str]) -> str | None:
    """The sentence with most of the question's words: 3 shared ones, or all there are."""
    words = {t for t in tk.query_tokens(question) if t not in STOP}
    ranked = [(len(words & set(tk.query_tokens(s))), -i, s.strip()) for i, s in enumerate(s for t in texts for s in re.split(r"[.!?।\n]+", t)) if s.strip()]
    best = max(ranked, default=(0, 0, None))
    return best[2] if best[0] >= min(3, max(1, len(words))) else None
