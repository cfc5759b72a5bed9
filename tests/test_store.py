"""The store's versions and deltas, the inverted index with kept statistics, and the vector index."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.vectors import embed_text
from docloom.operators import search
from docloom.operators.text_index import TextIndex
from docloom.operators.vector_index import VectorIndex, centres
from docloom.sources import store as stores
from docloom.sources.store import Conflict, Store

PAGES = "document_id string, page_number int, text string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PAGES)


def got(df):
    return sorted((r.document_id or "", r.page_number, r.text) for r in df.collect())


def files(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*") if p.is_file()}


def test_a_write_that_is_killed_leaves_the_version_before_it(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.write("pages", frame(spark, ("a", 1, "old"), ("b", 1, "old")))
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.write("pages", frame(spark, ("a", 1, "new")))
    again = Store(spark, str(tmp_path / "s"))
    assert got(again.read("pages")) == got(store.read("pages")) == [("a", 1, "old"), ("b", 1, "old")]
    again.write("pages", frame(spark, ("a", 1, "newer")))
    assert got(store.read("pages")) == [("a", 1, "newer"), ("b", 1, "old")]


def test_a_manifest_cut_short_counts_as_none(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.write("pages", frame(spark, ("a", 1, "old")))
    (tmp_path / "s" / "_versions" / f"{store.versions()[0] + 1:020d}.json").write_text('{"buckets": 4, "se')
    assert got(store.read("pages")) == [("a", 1, "old")]
    monkeypatch.setattr(stores, "GRACE_S", 0.5)
    store.merge("pages", frame(spark, ("a", 2, "more")))
    assert got(Store(spark, str(tmp_path / "s")).read("pages")) == [("a", 1, "old"), ("a", 2, "more")]


def test_a_transaction_is_one_version_or_none(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    before = store.versions()[0]
    with store.transaction():
        store.write("pages", frame(spark, ("a", 1, "x")))
        store.write("facts", spark.createDataFrame([("a", "f")], "document_id string, field string"))
        assert store.read("pages").count() == 1 and Store(spark, str(tmp_path / "s")).read("pages").count() == 0
    assert store.versions()[0] == before + 1 and store.read("facts").count() == 1
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.write("pages", frame(spark, ("a", 1, "y")))
        1 / 0  # noqa: B018
    assert got(store.read("pages")) == [("a", 1, "x")] and store.versions()[0] == before + 1


def test_a_small_write_touches_its_delta_alone(spark, tmp_path):
    root = tmp_path / "s"
    store = Store(spark, str(root), buckets=8)
    store.write("pages", spark.range(400).select(F.concat(F.lit("d"), "id").alias("document_id"), F.lit(1).alias("page_number"), F.lit("t").alias("text")))
    before = files(root)
    store.write("pages", frame(spark, ("d7", 2, "new")))
    after = files(root)
    assert all(after[p] == t for p, t in before.items()) and 0 < sum(p.suffix == ".parquet" for p in after.keys() - before.keys()) <= 2
    assert got(store.read("pages", ["d7"])) == [("d7", 2, "new")] and store.read("pages").count() == 400
    read = store.read("pages", ["d7"]).inputFiles()
    assert {p.split("bucket=")[1].split("/")[0] for p in read if "bucket=" in p and "_gone" not in p} == {str(store.bucket_of("d7"))}


def test_a_large_bucket_goes_to_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store = Store(spark, str(tmp_path / "s"), buckets=2)
        text = F.sha2(F.col("id").cast("string"), 512)
        store.write("pages", spark.range(10_000).repartition(8).select(F.concat(F.lit("d"), "id").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text")))
        assert len(list((tmp_path / "s" / "pages").rglob("bucket=0/*.parquet"))) > 3
        assert store.read("pages").select("document_id").distinct().count() == 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_versions_compaction_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.write("pages", frame(spark, *[(f"d{i}", 1, "one") for i in range(9)], (None, 1, "null")))
    first = store.versions()[0]
    for k in range(3):
        store.merge("pages", frame(spark, (f"d{k}", 1, "two"), (f"d{k}", 2, "new"), (None, 1, f"null {k}")))
    store.delete("d0", "d8")
    want = got(store.read("pages"))
    assert ("", 1, "null 2") in want and len(want) == 7 + 2 + 1 and ("d1", 1, "two") in want
    assert store.deltas("pages") == 5
    store.compact("pages")
    assert store.deltas("pages") == 1 and got(store.read("pages")) == want
    assert "Join" not in store.read("pages")._jdf.queryExecution().optimizedPlan().toString()
    assert store.read("pages", version=first).count() == 10
    assert store.vacuum(keep=1) == 0 and store.vacuum(keep=1, age_s=-5) == 5
    assert got(store.read("pages")) == want
    with pytest.raises(ValueError):
        store.read("pages", version=first)


def test_what_is_written_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, str(tmp_path / "s"), buckets=4) for _ in range(2))
    for k in range(3):
        store.merge("pages", frame(spark, ("a", k, "x")))
    whole = Store._merged
    monkeypatch.setattr(Store, "_merged", lambda self, *a, **k: (monkeypatch.undo(), other.write("pages", frame(spark, ("b", 1, "late"))), whole(self, *a, **k))[-1])
    store.compact("pages")
    assert got(store.read("pages")) == [("a", 0, "x"), ("a", 1, "x"), ("a", 2, "x"), ("b", 1, "late")] and store.deltas("pages") == 2
    store.merge("pages", frame(spark, ("c", 1, "y")))
    monkeypatch.setattr(Store, "_merged", lambda self, *a, **k: (monkeypatch.undo(), other.compact("pages"), whole(self, *a, **k))[-1])
    with pytest.raises(Conflict):
        store.compact("pages")


def test_two_writers_both_come_in(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, str(tmp_path / "s"), buckets=4) for _ in range(2))
    latest = Store._latest
    monkeypatch.setattr(Store, "_latest", lambda self: (latest(self), monkeypatch.undo(), other.write("pages", frame(spark, ("b", 1, "other"))))[0])
    store._commit(lambda m: {**m, "mark": 1})
    assert got(store.read("pages")) == [("b", 1, "other")] and store._latest()[1]["mark"] == 1


def test_random_writes_equal_a_dict(spark, tmp_path):
    rng, store, held = random.Random(4), Store(spark, str(tmp_path / "s"), buckets=3), {}
    for step in range(10):
        rows = {(f"d{rng.randrange(6)}", rng.randrange(3)): f"{step}.{i}" for i in range(rng.randrange(1, 6))}
        df = frame(spark, *[(d, p, t) for (d, p), t in rows.items()])
        kind = rng.choice(["write", "merge", "delete", "compact"])
        if kind == "write":
            store.write("pages", df)
            held = {k: v for k, v in held.items() if k[0] not in {d for d, _ in rows}} | rows
        elif kind == "merge":
            store.merge("pages", df)
            held |= rows
        elif kind == "delete":
            gone = f"d{rng.randrange(6)}"
            store.delete(gone)
            held = {k: v for k, v in held.items() if k[0] != gone}
        else:
            store.compact("pages")
        assert got(store.read("pages")) == sorted((d, p, t) for (d, p), t in held.items())
        some = sorted({d for d, _ in held})[:2]
        assert not some or got(store.read("pages", some)) == sorted((d, p, t) for (d, p), t in held.items() if d in some)


def test_buckets_on_the_driver_are_those_of_the_plan(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=17)
    values = ["", "a", "ünd 漢字", "x" * 100, None, "d123"]
    rows = spark.createDataFrame([(v,) for v in values], "document_id string").select("document_id", store._bucket("document_id").alias("b")).collect()
    assert all(store.bucket_of(r.document_id) == r.b for r in rows)


# --- inverted index and statistics


def texts(spark, rows):
    return spark.createDataFrame(rows, "document_id string, id string, collection string, text string")


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["हिंदी", "the", "of"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(f"d{i // 3}", f"c{i}", "content", None if i == 7 else " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))) for i in range(n)]


QUERIES = ["w0 w1", "w5", "the of w40", "हिंदी w2 w2", "nowhere", "w59 w58 w57", "w0 w1 w2 w3 w4 w5 w6"]


def test_index_equals_the_scan(spark, tmp_path):
    rows = corpus(600)
    index = TextIndex(Store(spark, str(tmp_path / "s"), buckets=4), blocks=64)
    index.update(texts(spark, rows))
    df = texts(spark, rows).fillna("", ["text"]).cache()  # to the index a null text is one without tokens
    index.update(texts(spark, [("z", "z1", "index", "w0 w1")]))
    for q in QUERIES:
        for k in (3, 20):
            want = [(r.id, r.score) for r in search.sparse(df, q, k=k).collect()]
            assert [(r.id, r.score) for r in index.sparse(q, k, "content").collect()] == want, q
            want = [(r.id, r.score) for r in search.bm25(df, q, k=k).collect()]
            assert [(r.id, r.score) for r in index.bm25(q, k, "content", phrases=df).collect()] == want, q
    scope = [f"d{i}" for i in range(0, 200, 3)]
    want = [(r.id, r.score) for r in search.sparse(search.in_scope(df, scope), "w0 w3", k=5).collect()]
    assert [(r.id, r.score) for r in index.sparse("w0 w3", 5, "content", scope).collect()] == want
    assert index.sparse("", 5).collect() == [] and index.bm25("!!", 5).collect() == []


def test_a_question_reads_its_tokens_buckets_and_blocks(spark, tmp_path):
    rows = [(f"d{i}", f"c{i}", "content", "rare " * (40 if i < 3 else 1) + "common " + " ".join(f"x{i}y{k}" for k in range(5))) for i in range(900)]
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    index = TextIndex(store, blocks=256)
    index.update(texts(spark, rows))
    df = index.sparse("rare common", 3, "content")
    assert [r.id for r in df.collect()] == ["c0", "c1", "c2"]
    read = {p.split("bucket=")[1].split("/")[0] for p in df.inputFiles() if "/postings/" in p}
    assert read == {str(store.bucket_of(t)) for t in ("rare", "common")}
    own = {r[0] for r in spark.createDataFrame([(f"d{i}",) for i in range(3)], "d string").select(F.pmod(F.xxhash64("d"), F.lit(256))).collect()}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    asked = set(map(int, re.findall(r"\d+", re.search(r"block#\d+ IN \(([\d,]+)\)", plan)[1] if " IN (" in plan else re.search(r"block#\d+ = (\d+)", plan)[1])))
    assert asked == own  # of 256 blocks those alone whose bound reaches the third score
    assert "PushedFilters: [In(token, [common,rare])" in df._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(token), ", "") or "token" in plan


def same_statistics(index, df):
    want = {(r.term, r.df, r.n_docs, round(r.avgdl, 9), round(r.idf, 9)) for r in search.corpus_stats(df.withColumn("text", F.coalesce("text", F.lit("")))).collect()}
    return {(r.term, r.df, r.n_docs, round(r.avgdl, 9), round(r.idf, 9)) for r in index.statistics("content").collect()} == want


def test_kept_statistics_equal_a_recount(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    index, held = TextIndex(store, blocks=16), {}

    def update(rows):
        for d in {r[0] for r in rows}:
            held[d] = [r for r in rows if r[0] == d]
        index.update(texts(spark, rows))

    def now():
        return texts(spark, [r for rows in held.values() for r in rows])

    update(corpus(60))
    assert same_statistics(index, now())
    update(corpus(30, seed=9))  # changed
    assert same_statistics(index, now())
    before = store.read("statistics").count()
    update(corpus(30, seed=9))  # again: nothing changes
    assert same_statistics(index, now()) and store.read("statistics").count() == before
    for d in ("d1", "d4"):
        held.pop(d)
    index.remove("d1", "d4")
    assert same_statistics(index, now())
    store.compact("statistics")
    assert same_statistics(index, now()) and store.deltas("statistics") == 1
    q = "w0 w1"
    rows = store.read("maxima").count()
    for name in ("postings", "maxima", "forward"):
        store.compact(name)
    assert store.read("maxima").count() < rows
    assert [(r.id, r.score) for r in index.sparse(q, 9, "content").collect()] == [(r.id, r.score) for r in search.sparse(now(), q, k=9).collect()]


def test_statistics_of_micro_batches(spark, tmp_path):
    schema = "document_id string, id string, collection string, text string"
    rows = corpus(45)
    for k in range(3):
        texts(spark, [r for i, r in enumerate(rows) if i // 15 == k]).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    index = TextIndex(Store(spark, str(tmp_path / "s"), buckets=4), blocks=16)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: index.update(df)).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert same_statistics(index, texts(spark, rows))


# --- vector index


def vectors(spark, n, width=16, seed=2, groups=12):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(groups, width))
    x = mid[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, width))
    rows = [(f"d{i}", f"v{i}", [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "document_id string, id string, dense array<float>")


def test_exact_search_equals_the_scan(spark, tmp_path):
    rows, df = vectors(spark, 700)
    index = VectorIndex(Store(spark, str(tmp_path / "s"), buckets=8), "content", cells=24)
    index.update(df)
    for i in (0, 5, 99):
        queries = [(rows[i][2], 1.0), (rows[i + 1][2], 0.7)]
        want = [(r.id, round(r.score, 6)) for r in search.dense_variants(df, queries, "dense", "id", 10).collect()]
        assert [(r.id, round(r.score, 6)) for r in index.search(queries, 10).collect()] == want
        near = {r.id for r in index.search(queries, 10, probes=6).collect()}
        assert len(near & {w for w, _ in want}) >= 9
    scope = [f"d{i}" for i in range(0, 700, 2)]
    want = [r.id for r in search.dense(search.in_scope(df, scope), rows[3][2], "dense", "id", 10).collect()]
    assert [r.id for r in index.search([(rows[3][2], 1.0)], 10, scope=scope).collect()] == want


def test_exact_search_skips_cells(spark, tmp_path):
    rows, df = vectors(spark, 600, groups=20, seed=5)
    index = VectorIndex(Store(spark, str(tmp_path / "s"), buckets=64), "content", cells=20)
    index.update(df)
    found = index.search([(rows[0][2], 1.0)], 3)
    read = {p.split("bucket=")[1].split("/")[0] for p in found.inputFiles() if "bucket=" in p}
    assert len(read) < 20 and found.collect()[0].id == "v0"


def test_updates_odd_vectors_and_refit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    index = VectorIndex(store, "content", cells=4)
    assert index.search([([1.0, 0.0], 1.0)], 3).collect() == []
    rows, df = vectors(spark, 120, width=4)
    odd = spark.createDataFrame([("o", "o1", None), ("o", "o2", [0.0] * 4), ("o", "o3", [1.0])], "document_id string, id string, dense array<float>")
    index.update(df.unionByName(odd))
    changed = spark.createDataFrame([("d3", "v3", [9.0, 9.0, -9.0, 9.0])], "document_id string, id string, dense array<float>")
    index.update(changed)
    index.remove("d5")
    now = df.filter("document_id NOT IN ('d3', 'd5')").unionByName(changed)
    q = [([1.0, 1.0, -1.0, 1.0], 1.0)]
    want = [(r.id, round(r.score, 6)) for r in search.dense_variants(now, q, "dense", "id", 8).collect()]
    assert want[0][0] == "v3" and [(r.id, round(r.score, 6)) for r in index.search(q, 8).collect()] == want
    index.cells = 9
    index.refit()
    assert [(r.id, round(r.score, 6)) for r in index.search(q, 8).collect()] == want and store.read("centres").count() == 9


def test_zero_questions_and_centres():
    x = np.eye(5)
    assert np.allclose(np.linalg.norm(centres(x, 3), axis=1), 1) and len(centres(x, 9)) == 5


def test_titles_are_embedded_once(spark, tmp_path):
    rows = [(f"d{i}", f"t{i}", embed_text(f"title number {i} {'monsoon' if i == 4 else 'x'}")) for i in range(30)]
    index = VectorIndex(Store(spark, str(tmp_path / "s"), buckets=4), "titles", cells=3)
    index.update(spark.createDataFrame(rows, "document_id string, id string, dense array<float>"))
    found = index.search([(embed_text("monsoon title"), 1.0)], 1)
    assert found.first().id == "t4" and "Python" not in found._jdf.queryExecution().executedPlan().toString()
