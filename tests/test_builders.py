"""Builders and evidence on small fixtures."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import builders, evidence


def lines(spark, *texts):
    return builders.lines_of(spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "document_id string, page_number int, text string"))


def leaves(df):
    return sorted((tuple(r.path), r.value) for r in df.collect())


def test_prose_keeps_the_first_of_a_key(spark):
    assert leaves(builders.prose_leaves(lines(spark, "Total : 5\nno pair\nTOTAL : 6", "Other : x"))) == [(("Other",), "x"), (("Total",), "5")]


def test_masthead_ends_at_the_first_line_that_is_no_name(spark):
    text = "Chief Editor\nAnil Kumar\nNita Rao\nPhone 12345\nSunita Arora"
    assert leaves(builders.masthead_leaves(lines(spark, text))) == [(("Chief Editor",), "Anil Kumar, Nita Rao")]


def test_lists_need_two_items(spark):
    got = leaves(builders.list_leaves(lines(spark, "Steps:\n- one\n- two\nend", "Single:\n- one\nend")))
    assert got == [(("Steps", "item 1"), "one"), (("Steps", "item 2"), "two")]


def test_assembly_prefers_earlier_parts_and_skips_contents_of_reports(spark):
    part = lambda *rows: spark.createDataFrame([(d, [k], v) for d, k, v in rows], "document_id string, path array<string>, value string")
    reports = spark.createDataFrame([("r",)], "document_id string")
    got = builders.assemble([part(("r", "A", "toc"), ("m", "A", "toc")), part(("r", "a", "table"), ("m", "a", "table")), part(("m", "B", "prose"))], reports)
    assert sorted((r.document_id, r.path[0], r.value) for r in got.collect()) == [("m", "A", "toc"), ("m", "B", "prose"), ("r", "a", "table")]


def test_address_continues_on_the_next_line(spark):
    got = builders.address_continuation(lines(spark, "Address : 12 Main Road\nDelhi\nPhone : 5", "Address : Hill\nPhone : 5")).orderBy("page_number").collect()
    assert [r.value for r in got] == ["12 Main Road, Delhi", "Hill"]


def test_cell_scores(spark):
    cells = spark.createDataFrame([("Trained", "Officers", "12"), ("Share", "Officers", "40%"), ("Trained", "Clerks", "")], "header string, label string, value string")
    got = evidence.cell_scores(cells, ["trained", "officers"], counting=True).collect()
    assert [r.value for r in got] == ["12"]


@pytest.mark.parametrize(("kind", "text", "want"), [("DURATION", "It took 12 days in all", "12 days"), ("PERCENTAGE", "a share of 40 %", "40 %"), ("PERSON", "by Anil Kumar today", "Anil Kumar"), ("DATE", "on 30.09.2024", "30.09.2024"), (None, "x", None)])
def test_factual_spans(kind, text, want):
    assert evidence.factual_span(kind, text) == want


def test_highlight_and_comparison(spark):
    assert evidence.highlight("abc ABC ab", ["ab", "abc"]) == [(0, 3), (4, 7), (8, 10)]
    row = spark.range(1).select(evidence.parse_comparison(F.lit("Poems: 3 → 5\nno\nStories: 1,200 → 900")).alias("c")).first()
    assert [tuple(x) for x in row.c] == [("Poems", 3.0, 5.0), ("Stories", 1200.0, 900.0)]


def test_authors_mentions_and_early_pages(spark):
    entries = spark.createDataFrame([("a1", "Monsoon", ["Nita Rao"]), ("a2", "Tulsi", ["Sunita Arora"])], "article_id string, title_original string, author_list array<string>")
    assert [r.article_id for r in evidence.title_or_author(entries, "Suneeta Arora").collect()] == ["a2"]
    docs = spark.createDataFrame([("report_kolkata_2024.docx",), ("report_delhi_2024.docx",)], "document_id string")
    assert evidence.mentioned_document(docs, "what happened in Delhi").first()[0] == "report_delhi_2024.docx"
    found = spark.createDataFrame([("x", 0.9, 12)], "id string, score double, page int")
    chunks = spark.createDataFrame([("y", 2), ("z", 30), ("x", 12)], "id string, page int")
    assert [r.id for r in evidence.early_pages(found, chunks, 5).collect()] == ["x", "y"]
