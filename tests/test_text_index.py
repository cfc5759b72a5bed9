"""How the inverted index is written: packed rows on the way, marks instead of maxima, several tasks a bucket."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import search, text_index
from docloom.operators.text_index import TextIndex
from docloom.sources.store import Store

COLUMNS = "document_id string, id string, collection string, text string"


def texts(spark, n, seed=0, base=0):
    rows = [(f"d{(base + i) // 2}", f"c{base + i}", "content", " ".join(f"w{(i * i + k * k + seed) % (k + 2)}" for k in range(i % 23)) + " often" * (i % 3) + (f" only{base + i}" if i % 5 else "")) for i in range(n)]
    return spark.createDataFrame([*rows, (f"n{base}", f"n{base}", "content", None), (f"e{base}", f"e{base}", "content", "...")], COLUMNS)


@pytest.mark.parametrize("words, maxima", [(10**9, 10**9), (40, 10**9), (10**9, 3), (40, 0)])
def test_index_equals_the_scan_however_it_is_written(spark, tmp_path, monkeypatch, words, maxima):
    monkeypatch.setattr(text_index, "TASK_WORDS", words)
    monkeypatch.setattr(text_index, "MOST_MAXIMA", maxima)
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    index = TextIndex(store, blocks=32)
    first, second = texts(spark, 240), texts(spark, 60, seed=5, base=200)
    index.update(first)
    index.update(second)
    now = first.join(second.select("document_id").distinct(), "document_id", "left_anti").select(*first.columns).unionByName(second)
    for q in ("often w1", "only7 often w0", "only3 only4", "w0 w1 w2 w3 w3"):
        assert [(r.id, r.score) for r in index.sparse(q, 9, "content").collect()] == [(r.id, r.score) for r in search.sparse(now, q, k=9).collect()]
        assert [(r.id, r.score) for r in index.bm25(q, 9, "content").collect()] == [(r.id, r.score) for r in search.bm25(now.fillna(""), q, k=9).collect()]
    want = {(r.term, r.df) for r in search.corpus_stats(now.fillna("")).collect()}
    assert {(r.term, r.df) for r in index.statistics("content").collect()} == want


def test_a_text_is_one_row_and_few_tokens_have_maxima(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    rows = texts(spark, 240)
    TextIndex(store, blocks=32).update(rows)
    assert store.read("forward").count() == rows.count()  # not a row a token
    own = {r.token: r.n for r in store.read("postings").groupBy("token").agg(F.count("*").alias("n")).collect()}
    kept = store.read("maxima").groupBy("token").agg(F.min("block").alias("least"), F.count("*").alias("n")).collect()
    assert {r.token for r in kept} == set(own)
    assert all((r.least, r.n) == (text_index.UNBOUNDED, 1) if own[r.token] <= 32 else r.least >= 0 for r in kept)


def test_an_index_without_its_forward_set_is_dropped_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    index = TextIndex(store)
    index.update(texts(spark, 20))
    store._commit(lambda m: {**m, "sets": {n: {**s, "schema": "token string"} if n == "forward" else s for n, s in m["sets"].items()}})
    assert set(store.ensure()) == {"postings", "maxima", "forward", "statistics"}
    index.update(texts(spark, 20))
    assert index.statistics("content", ["often"]).first().df == search.corpus_stats(texts(spark, 20).fillna("")).filter("term = 'often'").first().df
