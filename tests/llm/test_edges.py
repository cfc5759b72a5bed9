"""Every operator and stage: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import common, decontaminate, exact_dedup, jaccard_join, language_id, mixing, pii, quality, secrets_scan, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, rep long, label string, size long, tie long, key long"
LONG = "lorem ipsum dolor sit amet. " * 20_000
TEXTS = [None, "", "   \n\t", "!!! 123 ???", "a", "A", "the quick brown fox jumps over the lazy dog again", "the quick brown fox jumps over the lazy dog again", LONG, LONG + "x", "é" * 70_000, "\x00\x01 nul", "İstanbul ß ﬁ \U0001f600 emoji"]


def frame(spark, texts=TEXTS):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None, "b"][i % 3], len(t or ""), None, 1, 2, "x", 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[min(6, len(rows) - 1)]] * 2 + [(None, "null id", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)] if texts else []
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, empty=False):
    rows = [] if empty else [(i, i % 2, (i + 1) % 2, "clash") for i in range(13)] + [(3, None, None, None), (None, 1, 1, None), (4, 1, 0, "again")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def bench(spark, empty=False):
    rows = [] if empty else [(1, "the quick brown fox jumps over the lazy dog again and more", "x"), (2, None, "x"), (3, "", "x"), (4, "a", "x"), (None, "emoji", "x"), (1, "emoji", "y"), (5, "lorem ipsum", "y")]
    return spark.createDataFrame(rows, "item_id long, text string, n_words string")


OPERATORS = {
    "op1": lambda s, d, e: pii.personal_data(d), "op2": lambda s, d, e: toxicity.severities(d, labels(s, e)), "op3": lambda s, d, e: quality.qualities(d, labels(s, e)), "op4": lambda s, d, e: exact_dedup.exact_groups(d),
    "op5": lambda s, d, e: decontaminate.contamination(d, bench(s, e)), "op6": lambda s, d, e: secrets_scan.secrets(d), "op7": lambda s, d, e: mixing.mix(d), "op8": lambda s, d, e: substring_dedup.dedup(d),
    "op9": lambda s, d, e: language_id.languages(d), "op10": lambda s, d, e: jaccard_join.similar_components(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_has_a_row_for_each_document(spark, name):
    d = frame(spark)
    got = OPERATORS[name](spark, d, False).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in d.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_empty_tables(spark, name):
    assert OPERATORS[name](spark, frame(spark, []), True).collect() == []
    d = frame(spark, ["one text", None])
    assert len(OPERATORS[name](spark, d, True).collect()) == d.count()


STAGES = {
    "language": language_id.recognised_rows, "exact": exact_dedup.keep_rows, "near": jaccard_join.first_of_groups, "mixed": mixing.mixed_rows,
}


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_edges(spark, name):
    d = frame(spark)
    got = STAGES[name](d)
    assert got.columns[: len(d.columns)] == d.columns
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in d.collect()}
    assert STAGES[name](frame(spark, [])).collect() == []


def test_exact_stage_leaves_one_of_equal_rows(spark):
    got = [r.doc_id for r in exact_dedup.keep_rows(frame(spark)).collect()]
    assert got.count(7) == 1 and 6 not in got and 4 not in got and 5 in got and len(got) == len(set(got))


def test_near_stage_keeps_documents_without_shingles(spark):
    got = {r.doc_id for r in jaccard_join.first_of_groups(frame(spark)).collect()}
    assert {0, 1, 2, None} <= got and 7 not in got and 9 not in got


def test_decontamination_stage(spark):
    d = frame(spark)
    got = {r.doc_id for r in decontaminate.clean_rows(d, bench(spark)).collect()}
    assert {0, 1, 2, 3} <= got and not got & {4, 5, 6, 7, 8, 9, 12}
    assert decontaminate.clean_rows(d, bench(spark, True)).count() == d.count()


def test_pipeline_end_to_end(spark, tmp_path):
    word = {"en": "the thing over", "de": "der und nicht"}
    texts = [(i, " ".join(f"{w}{(i * 7 + k) % 50}x" if k % 3 == 0 else w for k in range(20) for w in word[["en", "de"][i % 2]].split()), ["en", "de"][i % 2], f"s{i % 3}", 1) for i in range(60)]
    item = " ".join(f"bench{k}" for k in range(12))
    texts += [(100, texts[0][1], "en", "s0", 1), (101, texts[2][1] + " end", "en", "s0", 1), (102, item + " over the thing", "en", "s1", 1), (103, "12345 !!", None, "s1", 1), (104, None, None, None, None)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {0, 102, 103, 104}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(len(v) * v[0].size == v[0].taken and sorted(r.copy for r in v) == list(range(1, len(v) + 1)) for v in by.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontaminate", "mixing"]


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "docloom").rglob("*.py"):
        if "llm" not in p.relative_to(root / "docloom").parts:
            assert "docloom.llm" not in p.read_text()


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {q.split("_")[0] for q in e.queries() if q.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in e.queries()


def test_skewed_key_is_split(spark, monkeypatch):
    """A text that a third of the rows share reaches its owner as a row for each map task, and its entries meet it by broadcast."""
    monkeypatch.setattr(common, "HOT", 500)
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    found = exact_dedup.exact_groups(d)
    got = found.groupBy("group_size").count().collect()
    assert {(r.group_size, r["count"]) for r in got} == {(1000, 1000), (1, 2000)}
    assert found._jdf.queryExecution().toString().count("BroadcastHashJoin") >= 2


def test_one_of_rows_that_differ_elsewhere_is_always_the_same(spark):
    rows = [(1, "a", s) for s in ("x", "y", "z", None)] + [(None, "b", "q"), (None, "b", "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 3, 5):
        assert [(r.doc_id, r.source) for r in exact_dedup.keep_rows(d.repartition(parts)).orderBy("doc_id").collect()] == [(None, "q"), (1, "x")]
