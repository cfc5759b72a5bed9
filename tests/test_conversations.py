"""Follow-up questions, and conversation state that lasts over restarts."""

import pytest

from docloom.plans import engine as engines
from docloom.plans.engine import Engine
from docloom.sources.store import Store
from docloom.streaming.ingest import ROCKSDB, conversation_state, last_by_conversation, remember, state_of

TOC = "Contents\nTechnical\n1. Cloud Basics : Anil Kumar ..... 5\n2. Safe Passwords : Sunita Arora ..... 9\nPoem\n3. Monsoon : Nita Rao ..... 14"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    pages = [("mag_2024.docx", 1, TOC), ("mag_2024.docx", 2, "The editorial speaks of clouds over the quiet valley in June.")]
    Engine(spark, folder).ingest(spark.createDataFrame(pages, "document_id string, page_number int, text string"))
    return folder


def test_follow_up_questions(spark, root):
    e = Engine(spark, root)
    assert e.ask("Which page is Monsoon article?", conversation_id="a").stage == "contents_page_of"
    got = e.ask("Who is its author?", conversation_id="a")
    assert (got.stage, got.text) == ("follow_up_author_original", "Nita Rao")
    assert e.ask("On which page is that article?", conversation_id="a").text == "page 14"
    assert e.ask("इसका लेखक कौन है?", conversation_id="a").text == "Nita Rao" and e.ask("uska lekhak kaun hai", conversation_id="a").text == "Nita Rao"
    assert e.ask("Which section is it in?", conversation_id="a").text == "Poem"
    other = e.ask("Who is its author?", conversation_id="b")
    assert not other.stage.startswith("follow_up")


def test_conversations_last_over_a_restart_and_are_forgotten(spark, root, monkeypatch):
    Engine(spark, root).ask("Who is the author of Safe Passwords?", conversation_id="c")
    again = Engine(spark, root)
    assert again.last_article("c") == "mag_2024.docx:article:2" and again.ask("Which page is it on?", conversation_id="c").text == "page 9"
    assert again.last_article("c", within_s=-1) is None and again.last_article("nobody") is None


def test_a_follow_up_of_an_article_that_is_gone_is_a_question_like_others(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(spark.createDataFrame([("m.docx", 1, TOC)], "document_id string, page_number int, text string"))
    e.ask("Who is the author of Monsoon?", conversation_id="x")
    e.delete("m.docx")
    assert e.ask("Who is its author?", conversation_id="x").stage == "none"


def test_many_turns_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engines, "MOST_DELTAS", 3)
    e = Engine(spark, str(tmp_path / "s"))
    for i in range(6):
        e._remember("a", f"article {i}")
    assert e.last_article("a") == "article 5" and e.store.deltas("conversations") <= 4


SCHEMA = "conversation_id string, turn long, article_id string"
TURNS = [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")]


def test_streams_are_remembered_in_the_store(spark, root, tmp_path):
    turns = [(f"stream {c}", t, x) for c, t, x in TURNS]
    for k, rows in enumerate((turns[:2], [*turns[2:], ("s", 7, "mag_2024.docx:article:3")])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):
        assert remember(Store(spark, root), stream, str(tmp_path / "c")).awaitTermination(120)
    assert Engine(spark, root).ask("Who is its author?", conversation_id="s").text == "Nita Rao"
    got = {(r.document_id, r.turn, r.article_id) for r in Store(spark, root).read("conversations").filter("document_id LIKE 'stream %'").collect()}
    assert got == {("stream b", 1, "q"), ("stream a", 3, "z")}


def test_state_lasts_and_is_read_back(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for k, rows in enumerate((TURNS[:2], TURNS[2:])):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
            query = conversation_state(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: None if df.count() < 0 else None).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        want = {tuple(r) for r in last_by_conversation(spark.createDataFrame(TURNS, SCHEMA)).select("conversation_id", "turn", "article_id").collect()}
        assert {tuple(r) for r in state_of(spark, str(tmp_path / "c")).collect()} == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
