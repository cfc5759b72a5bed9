"""Slots of the structural predicate, and titles: what may fit is chosen before scores are taken."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import script
from docloom.functions.vectors import embed_text
from docloom.operators import contents, structure
from docloom.plans.engine import Engine
from docloom.plans.questions import ATTRIBUTES

POINT = "id int, node_key string, node_value string, node_type string, row_entity string, parent_key string, root_section string, hierarchy_path array<string>"


def states(spark, asked, *points, listing=False):
    df = structure.with_labels(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], POINT), ATTRIBUTES)
    state = structure.eligibility(structure.slot_states(asked, ATTRIBUTES), F.col("node_type") == "leaf", F.col("node_value"), listing)
    return [r.s for r in df.select("id", state.alias("s")).orderBy("id").collect()]


def leaf(key="Phone", value="1", row=None, parent="Office", section="3. Letters", path=("3. Letters", "Office", "Phone")):
    return (key, value, "leaf", row, parent, section, list(path) if path is not None else None)


V, U, C = "VALID", "UNKNOWN", "CONTRADICTED"


def test_field_rule(spark):
    """Labels of the node's key, or of the last element of a leaf's path where the key is its row or parent; none is unknown."""
    asked = structure.Slots(field="phone")
    assert states(spark, asked, leaf(), leaf("दूरभाष"), leaf("Telephone number"), leaf("Address"), leaf("Office", path=("a", "Office", "Phone"))) == [V, V, V, C, V]
    assert states(spark, asked, ("Office", None, "branch", None, "Office", None, None), leaf(None, path=None)) == [U, U]
    assert states(spark, structure.Slots(field="total letters"), leaf("Total  Letters:"), leaf("TotalLetters"), leaf("letters")) == [V, V, C]


def test_type_rule(spark):
    df = spark.createDataFrame([("NUMERIC",), ("TEXT",), (None,)], "t string")
    state = structure.eligibility([structure.type_slot("COUNT", F.col("t"))])
    assert [r[0] for r in df.select(state).collect()] == [V, C, U]


def test_entity_rule(spark):
    """The row's entity, else the path above, else the parent."""
    asked = structure.Slots(entity="Anil Kumar")
    found = states(spark, asked, leaf(row="Anil Kumar"), leaf(row="अनिल कुमार"), leaf(row="Nita Rao"), leaf(path=("x", "anil-kumar", "Phone")), leaf(path=("x", "y", "Phone")), leaf(parent="ANIL KUMAR", path=("Phone",)), leaf(parent=None, path=None))
    assert found == [V, C, C, V, C, V, U]
    assert states(spark, structure.Slots(entity="anila kumara"), leaf(row="अनिल कुमार")) == [V if script.romanize_text("अनिल कुमार") == "anila kumara" else C]


def test_section_rule(spark):
    """The root section, else the path; numbers of sections are a label of their own."""
    assert states(spark, structure.Slots(section="3"), leaf(), leaf(section="Section 4"), leaf(section=None, path=("Section 3", "x")), leaf(section=None, path=None)) == [V, C, V, U]
    assert states(spark, structure.Slots(section="3(2)"), leaf(section="3 (2) Letters"), leaf(section="3 Letters")) == [V, C]
    assert states(spark, structure.Slots(section="letters issued"), leaf(section="Letters Issued"), leaf(section="LettersIssued")) == [V, V]


def test_direction_and_language_rules(spark):
    for asked in (structure.Slots(direction="sent"), structure.Slots(source_language="hindi"), structure.Slots(target_language="english")):
        assert states(spark, asked, leaf()) == [U]
    assert states(spark, structure.Slots(field="phone", direction="sent"), leaf(), leaf("Address")) == [U, C]


def test_combination_rule(spark):
    """A contradiction wins; a branch or a blank value is unknown but for lists; nothing asked is unknown."""
    asked = structure.Slots(field="phone", section="3")
    branch = ("Phone", None, "branch", None, "Office", "3. Letters", ["3. Letters", "Phone"])
    assert states(spark, asked, leaf(), leaf(value=" "), branch, leaf(section="4")) == [V, U, U, C]
    assert states(spark, asked, branch, listing=True) == [V] and states(spark, structure.Slots(), leaf()) == [U]


def test_slots_through_ask(spark, tmp_path):
    """The field asked for keeps out a point that fits the words as well; the section, direction and language slots leave it eligible."""
    e = Engine(spark, str(tmp_path / "s"))
    text = "Office details of the Delhi branch\nOffice Address : 12 Main Road Delhi\nOffice Telephone : 011 5550199\nOffice Email : a@b.example"
    e.ingest(spark.createDataFrame([("a.docx", 1, text)], "document_id string, page_number int, text string"))
    assert "011 5550199" in e.ask("What is the office phone?").text and "a@b.example" in e.ask("What is the office email?").text
    assert "12 Main Road" in e.ask("What is the office address?").text
    stored = e.store.read("points").filter("node_key = 'Office Telephone'").first()
    assert "attribute:phone" in stored.field_labels and {"office telephone", "officetelephone"} <= set(stored.field_labels)


# --- titles


def entries(spark, n=400):
    rng = random.Random(7)
    words = ["cloud", "basics", "safe", "passwords", "monsoon", "rajbhasha", "vikas", "kavita", "meri", "yatra", "in", "the", "of", "data", "सुरक्षा", "हिंदी", "दिवस", "technology"]
    titles = {" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(n)} | {"Monsoon", "monsoons", "Cloud Basics: a first look", "", "!!!"}
    rows = [("d", i, t, None) for i, t in enumerate(sorted(titles))]
    df = spark.createDataFrame(rows, "document_id string, serial_number int, title_original string, author_original string")
    return contents.enrich(df.withColumn("section_original", F.lit("General")))


QUERIES = ["monsoon", "cloud basics", "clud basics", "safe passwords of data", "हिंदी दिवस", "hindi divas", "technology", "the", "sf psswrds", "mansoon", "", "???", "kavita meri yatra the"]


@pytest.mark.parametrize("resolve", [contents.resolve_title, contents.resolve_article])
def test_titles_resolve_as_by_a_full_scan(spark, resolve, monkeypatch):
    e = entries(spark).cache()
    found = [[(r.article_id, r.score) for r in resolve(e, q).collect()] for q in QUERIES]
    monkeypatch.setattr(contents, "title_candidates", lambda rows, *_: rows)
    assert found == [[(r.article_id, r.score) for r in resolve(e, q).collect()] for q in QUERIES] and sum(map(len, found)) >= 2


def test_scores_are_taken_of_candidates_alone(spark):
    e = entries(spark)
    for ratio, score in ((0.74, script.title_score_text), (None, script.article_score_text)):
        for q in ("monsoon", "cloud basics", "हिंदी दिवस"):
            kept = {r.title_original for r in contents.title_candidates(e, q, ratio).collect()}
            every = [r.title_original for r in e.collect()]
            assert {t for t in every if score(q, t) >= (ratio * 0.92 if ratio else 1e-9)} <= kept and len(kept) < 0.6 * len(every)
    plan = contents.resolve_title(spark.createDataFrame(e.collect(), e.schema), "monsoon")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter")  # the filter stands below


def test_stored_title_vectors_are_not_embedded_again(spark):
    e = entries(spark, 30).withColumn("dense", F.array(*[F.lit(float(x)) for x in embed_text("monsoon")]).cast("array<float>"))
    plan = contents.resolve_semantic(e.select(*e.columns), "monsoon", embed_text("monsoon"), lambda c: 1 / 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "dense" in plan
