"""The shared folder, batches and samples."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import common
from docloom.llm.common import ASCII_LOWER, DEFAULT_SHARED_DIR, ascii_lower, chunks, shared_dir, write_shared
from docloom.llm.sampling import labelled_texts, sampled


def test_shared_tables_lie_in_the_shared_folder(spark):
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = write_shared(spark.range(5), "t")
    folder = spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_SHARED_DIR
    assert shared_dir(spark) == folder and df.count() == 5 and all(folder in f for f in df.inputFiles())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows


def test_ascii_lower_touches_a_to_z_alone(spark):
    texts = ["ABC xyz", "ÄÖ ABC İ", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t"))).collect()]
    assert got == [(t or "").translate(ASCII_LOWER) for t in texts]


def test_chunks_hold_every_row_in_order():
    rows = [(i, None if i % 7 == 0 else "x" * (i % 50)) for i in range(1000)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
    parts = list(chunks([batch.slice(0, 300), batch.slice(300)], 200))
    assert [r for ids, texts in parts for r in zip(ids, texts, strict=True)] == rows
    assert all(sum(len(t or "") for t in texts) <= 200 or len(texts) == 1 for _, texts in parts)


def test_samples_are_bounded_and_don_t_depend_on_partitions(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("label"))
    got = {r["label"]: r["count"] for r in sampled(rows, "label", 500).groupBy("label").count().collect()}
    assert got["rare"] == 200 and 380 < got["common"] < 620
    docs = rows.select("doc_id", F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("text"))
    assert labelled_texts(docs, rows, "label", 20) == labelled_texts(docs.repartition(5), rows.repartition(3), "label", 20)


@pytest.mark.parametrize("most", [1, 3, 100])
def test_hot_keys_are_split_however_many_there_are(spark, monkeypatch, most):
    """Where more keys are hot than are broadcast, the bound rises until the largest ones stand out."""
    monkeypatch.setattr(common, "HOT", 10)
    monkeypatch.setattr(common, "HOT_KEYS", most)
    sizes = {f"k{i}": 11 + i for i in range(8)} | {"hot": 3000, "hotter": 4000, "cold": 2}
    rows = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "k string, i int")
    table = spark.createDataFrame(list(sizes.items()), "k string, n long")
    joined = common.by_key(rows, table, ["k"], "n")
    assert {r.k: r["count"] for r in joined.groupBy("k").count().collect()} == sizes
    bound = common.hot_bound(table, "n")
    above = [n for n in sizes.values() if n > bound]
    assert len(above) <= most and bound <= max(10, 4 * sum(sizes.values()) / most)
    assert common.hot_bound(table.filter("n < 5"), "n") is None


def test_equal_rows_meet_in_many_nodes(spark, monkeypatch):
    from docloom.llm import mixing

    monkeypatch.setattr(common, "HOT", 100)
    rows = [(1, "same text of five words", "s")] * 3000 + [(i, "w " * (i % 9), "s") for i in range(2, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.numbered(d.select("doc_id", "source", F.lit(5).cast("long").alias("size"), F.xxhash64("doc_id", "source", "text").alias("tie")))
    own = sorted(r.number for r in found.filter("doc_id = 1").collect())
    assert own == list(range(3000)) and {r.number for r in found.filter("doc_id > 1").collect()} == {0} and found.count() == len(rows)
    nodes = found.groupBy(F.pmod(F.xxhash64(F.lit(17), "tie", "number"), F.lit(30))).count().collect()
    assert max(r["count"] for r in nodes) < 200
    first = sorted((r.doc_id, r.taken) for r in mixing.mix(d.repartition(3), block=200).collect())
    assert first == sorted((r.doc_id, r.taken) for r in mixing.mix(d.repartition(7), block=200).collect()) and len(first) == len(rows)
    total = sum(n for _, n in first)
    assert abs(total - 1.5 * sum(len(t.split()) for _, t, _ in rows)) < 0.01 * total
