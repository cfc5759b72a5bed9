"""Operators on small golden fixtures."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import contents, metrics, pages, search, structure, tables, terms


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def ranked(spark, ids):
    return spark.createDataFrame(list(enumerate(ids)), "rank int, id string")


def test_rrf_fixture(spark):
    got = search.fuse([ranked(spark, "abc"), ranked(spark, "cad")]).select("id", "rrf_score").collect()
    assert [(r.id, r.rrf_score) for r in got] == [("a", 0.032522), ("c", 0.032266), ("b", 0.016129), ("d", 0.015873)]
    assert max(r.rrf_score for r in got) <= 2 / 61


def test_scope_and_filters(spark):
    df = spark.createDataFrame([("d1", 2024), ("d2", 2025), (None, 2025)], "document_id string, year int")
    assert search.in_scope(df, None).count() == 3 and search.in_scope(df, []).count() == 3
    assert search.in_scope(df, ["d2"]).count() == 1
    assert search.metadata_filter(df, ["d2"], document_id="d1", year="x", document_type="all").count() == 1


def test_region_totals_list_percent_rows_without_a_sum(spark):
    df = spark.createDataFrame([("Total letters", "क", 270.0, False), ("Total letters", "ख", 86.0, False), ("Total letters", "ग", 99.0, False), ("Share", "क", 75.0, True), ("Share", "ख", 70.0, True), ("One", "क", 1.0, False)], "m string, region string, value double, p boolean")
    assert rows(metrics.region_totals(df, ["m"], "region", "value", "p"), "m") == [("Share", 2, None, True), ("Total letters", 3, 455.0, False)]


def test_records_from_a_sectioned_table(spark):
    grid = [["3.", "Letters issued", ""], ["", "Region ‘A’", ""], ["", "Total letters", "270"], ["", "Share in Hindi", "75%"], ["", "Region ‘B’", ""], ["", "Total letters", "86"], ["1", "2", "3"]]
    cells = spark.createDataFrame([("t", i, j, f"h{j}", v) for i, r in enumerate(grid) for j, v in enumerate(r)], "table_id string, row_index int, col_index int, header string, value string")
    got = metrics.records_from_cells(cells).select("section_no", "section", "region", "metric", "value", "is_percent", "row_index")
    assert [r[:6] for r in rows(got, "row_index")] == [("3", "Letters issued", "क", "Total letters", 270.0, False), ("3", "Letters issued", "क", "Share in Hindi", 75.0, True), ("3", "Letters issued", "ख", "Total letters", 86.0, False)]


def test_fuzzy_merge_never_takes_a_filled_period(spark):
    df = spark.createDataFrame([("s", "total letters", "2024", 1), ("s", "total lettrs", "2025", 2), ("s", "total letter", "2024", 3)], "section string, metric_key string, period string, position int")
    got = {r.metric_key: r.merged_key for r in metrics.fuzzy_merge(df, ["section"]).collect()}
    assert got == {"total letters": "total letters", "total lettrs": "total letters", "total letter": "total letter"}


def test_contents_ranking_and_clusters(spark):
    df = spark.createDataFrame([("Anil Kumar", 1), ("Sunita Arora", 2), ("Suneeta Arora", 3), ("Anil Kumar", 4), ("Nita Rao", 5)], "author string, position int")
    named = df.join(contents.author_clusters(df), "author").select(F.col("cluster").alias("author"))
    assert rows(contents.author_ranking(named), F.desc("works"), "author") == [("Anil Kumar", 2), ("Sunita Arora", 2), ("Nita Rao", 1)]
    assert not contents.strict_author_text("nita", "Sunita Arora")


def test_breakdown_has_a_total_row(spark):
    df = spark.createDataFrame([("Technical", "a"), ("Technical", "a"), (None, "a"), ("Technical", "b")], "s string, e string")
    got = {(r.section, r.is_total): (r.a, r.b) for r in contents.breakdown(df, "s", "e", ["a", "b"]).collect()}
    assert got == {("Technical", False): (2, 1), ("General", False): (1, 0), (None, True): (3, 1)}


def test_nth_falls_back_to_the_first(spark):
    df = spark.createDataFrame([("d", 1, "Cloud Basics"), ("d", 2, "Safe Passwords"), ("d", 3, "Monsoon")], "d string, n int, t string")
    assert [contents.nth(df, ["d"], ["n"], n).first().t for n in ("first", "last", 2, 9)] == ["Cloud Basics", "Monsoon", "Safe Passwords", "Cloud Basics"]


def test_toc_lines(spark):
    lines = ["Technical", "1. Cloud Basics : Anil Kumar ..... 5", "2. Safe Passwords : Sunita Arora and Anil Kumar 9", "Poem", "3 Monsoon : Nita Rao 14"]
    df = spark.createDataFrame([("m", 1, i, x) for i, x in enumerate(lines)], "document_id string, page_number int, line_no int, line string")
    got = contents.toc_from_lines(df).orderBy("serial_number").collect()
    assert [(r.section_original, r.title_original, r.page_number, r.type) for r in got] == [("Technical", "Cloud Basics", 5, "article"), ("Technical", "Safe Passwords", 9, "article"), ("Poem", "Monsoon", 14, "poem")]
    assert got[1].author_list == ["Sunita Arora", "Anil Kumar"] and got[0].article_id == "m:article:1"


def test_hierarchy_fixture(spark):
    leaves = spark.createDataFrame([("d1", ["Staff", "Officers", "Trained"], "12"), ("d1", ["Staff", "Officers", "Share"], "40%"), ("d1", ["Staff", "Clerks", "Trained"], "30")], "document_id string, path array<string>, value string")
    points = structure.hierarchy_points(leaves)
    below = structure.descendants(points, spark.createDataFrame([("d1", ["Staff"])], "document_id string, prefix array<string>"))
    assert rows(below.groupBy("depth").count(), "depth") == [(2, 2), (3, 3)]
    assert points.filter("id = 'd1::hier::leaf::Staff > Officers > Trained = 12'").count() == 1
    assert {r.value_type for r in points.collect()} == {"NUMERIC", "PERCENTAGE", "BRANCH"}
    state = structure.eligibility([structure.type_slot("COUNT", F.col("value_type"))], F.col("node_type") == "leaf", F.col("node_value"))
    got = {r.hierarchy_path_text: r.s for r in points.withColumn("s", state).collect()}
    assert got["Staff > Officers > Trained = 12"] == "VALID" and got["Staff > Officers > Share = 40%"] == "CONTRADICTED" and got["Staff"] == "CONTRADICTED"


@pytest.mark.parametrize(("states", "want"), [((True, True), "VALID"), ((True, None), "UNKNOWN"), ((None, False), "CONTRADICTED"), ((False, True), "CONTRADICTED"), ((None, None), "UNKNOWN")])
def test_kleene_table(spark, states, want):
    cols = [F.lit(s).cast("boolean") for s in states]
    assert spark.range(1).select(structure.eligibility(cols)).first()[0] == want


def test_rerank_puts_valid_first(spark):
    df = spark.createDataFrame([("a", 0.9, "UNKNOWN"), ("b", 0.1, "VALID"), ("c", 2.0, "CONTRADICTED")], "id string, rerank_score double, structural_eligibility string")
    assert [r.id for r in structure.rerank(df).collect()] == ["b", "a"]


def test_matrix_cells_and_headers(spark):
    df = spark.createDataFrame([("t", [["A", "", "A"], ["1", "2", "3"], ["", "", ""], ["4"]])], "table_id string, matrix array<array<string>>")
    got = tables.matrix_cells(df)
    assert [r.header for r in got.filter("row_index = 0").orderBy("col_index").collect()] == ["A", "Column 2", "A (2)"]
    assert got.count() == 6
    full = spark.createDataFrame([("t", 0, c, "h", "x") for c in range(3)], "table_id string, row_index int, col_index int, header string, value string")
    assert tables.confidence(full).first().extraction_confidence == 0.95


def test_table_arithmetic(spark):
    cells = spark.createDataFrame([("t", i, j, h, v) for i, r in enumerate([("Road", "10 km"), ("Rail", "4 km")]) for j, (h, v) in enumerate(zip(("name", "length"), r))], "table_id string, row_index int, col_index int, header string, value string")
    ask = lambda q: [(float(r.answer), r.unit, r.label) for r in tables.calculate(cells, q).collect()]
    assert ask("difference in length") == [(6.0, "km", None)] and ask("highest length") == [(10.0, "km", "Road")] and ask("average length") == [(7.0, "km", None)] and ask("sum of length") == [(14.0, "km", None)]
    mixed = cells.withColumn("value", F.when(F.col("value") == "4 km", "4 kg").otherwise(F.col("value")))
    assert tables.calculate(mixed, "average length").count() == 0


def test_segments_and_chunks(spark):
    texts = ["Contents\n1 Cloud .... 5\n2 Safe .... 9\n3 Rain .... 14", "word " * 200, "word " * 200, "word " * 200]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)] + [("one", 1, "alone")], "document_id string, page_number int, text string")
    assert [r.segment_type for r in pages.segment(df).orderBy("document_id", "page_number").collect()] == ["index", "content", "content", "content", "content"]
    long = spark.createDataFrame([("d", 1, "\n\n".join("w%d " % i * 60 for i in range(8)))], "document_id string, page_number int, text string")
    got = pages.chunk(long).orderBy("chunk_no").collect()
    assert all(len(r.chunk) <= 750 + 120 for r in got) and got[1].chunk.startswith(" ".join(got[0].chunk.split()[-20:]))


def test_aliases_of_any_length_are_found(spark):
    texts = spark.createDataFrame([(1, "see the right to information act of 2005 today"), (2, "the act")], "id int, text string")
    aliases = spark.createDataFrame([("right to information act of 2005", "rti"), ("act", "a"), (None, "x")], "alias string, key string")
    assert {(r.id, r.key) for r in terms.alias_join(texts, aliases).collect()} == {(1, "rti"), (1, "a"), (2, "a")}
    assert rows(terms.longest_matches(texts, aliases).select("id", "start", "words"), "id") == [(1, 2, 6), (2, 1, 1)]
    named = spark.createDataFrame([("Right to Information Act of 2005",)], "term string")
    assert [r.id for r in terms.first_containing(named, texts).collect()] == [1]
    assert terms.alias_join(texts, aliases.limit(0)).count() == 0 and terms.longest_matches(texts, aliases.limit(0)).count() == 0


def test_alias_join_and_longest_matches(spark):
    texts = spark.createDataFrame([(1, "of the law and the law of the land"), (2, None), (3, "")], "id int, text string")
    aliases = spark.createDataFrame([("the", "a"), ("of the", "b"), ("the law", "c")], "alias string, key string")
    assert {(r.alias, r.n) for r in terms.alias_join(texts, aliases).collect()} == {("the", 3), ("of the", 2), ("the law", 2)}
    assert [(r.start, r.alias) for r in terms.longest_matches(texts, aliases).orderBy("start").collect()] == [(0, "of the"), (4, "the law"), (6, "of the")]


def test_form_pairs_keep_blank_apart(spark):
    df = spark.createDataFrame([("d", 1, "Name of office : Main\nPhone : \nzero : 0"), ("d", 2, "just : one")], "document_id string, page_number int, text string")
    got = {r.label: r.value_state for r in terms.form_pairs(df).collect()}
    assert got == {"Name of office": "present", "Phone": "blank", "zero": "present"}


def test_no_python_and_no_cartesian_in_search_plans(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "the cat"), ("b", [0.0, 1.0], "the dog")], "id string, embedding array<float>, text string")
    for plan in (search.dense(df, [1.0, 0.0]), search.sparse(df, "the cat"), search.bm25(df, "the cat")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in text and "Python" not in text and "CartesianProduct" not in text
