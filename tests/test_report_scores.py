"""Scores of report records: each kind of evidence, and all of it against a plain computation on random questions and records."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import report_scores as rs

RECORD = "metric string, section string, region_header string, is_percent boolean"


def kinds(spark, question, *records):
    df = spark.createDataFrame([(*r, None, False)[:4] if len(r) < 4 else r for r in records], RECORD)
    cols = rs.evidence(rs.asked(question), *map(F.col, ("metric", "section", "region_header", "is_percent")))
    return [r.asDict() for r in df.select(*[c.alias(k) for k, c in cols.items()]).collect()]


@pytest.mark.parametrize(("question", "kind", "records", "want"), [
    ("what percent of letters", "share", [("a", "s", None, True), ("a", "s", None, False)], [1.5, 0.0]),
    ("how many letters", "share", [("a", "s", None, True)], [-20.0]),
    ("letters in the year", "share", [("a", "s", None, True), ("a", "s", None, None)], [-1.5, 0.0]),
    ("total letters", "total", [("Total letters", "s"), ("letters", "s")], [1.5, 0.0]),
    ("letters received in hindi", "source", [("x", "Letters received in Hindi"), ("x", "Letters received in English"), ("Hindi", None)], [7.0, -7.0, -7.0]),
    ("replies not required", "unneeded", [("reply not required", "s"), ("replied in hindi", "s")], [14.0, -14.0]),
    ("letters received", "receipt", [("Received", "s"), ("Replied", "s"), ("Total", "s")], [10.0, -10.0, 0.0]),
    ("letters replied", "reply", [("Replied", "s"), ("Received", "s")], [8.0, -8.0]),
    ("replies not required", "reply", [("reply not required", "s"), ("reply", "s")], [8.0, -8.0]),
    ("received in hindi and replied in english", "language", [("replied in English", "s"), ("replied in Hindi", "s")], [8.0, -8.0]),
    ("letters in hindi and english", "language", [("in Hindi", "s"), ("अंग्रेजी में", "s"), ("Total", "s")], [4.0, 4.0, -10.0]),
    ("total letters in hindi and english", "language", [("Total", "s"), ("sum", "s")], [4.0, -10.0]),
    ("letters in hindi", "language", [("हिंदी में", "s"), ("x", "Letters in Hindi"), ("in English", "s")], [4.0, 4.0, -10.0]),
    ("letters sent", "direction", [("x", "Letters sent"), ("x", "Letters received"), ("x", "Letters to"), ("x", "y")], [10.0, -10.0, 10.0, 0.0]),
    ("letters from region a", "direction", [("x", "Letters received"), ("x", "issued", "from A")], [10.0, 0.0]),
])
def test_each_kind_of_evidence(spark, question, kind, records, want):
    assert [r[kind] for r in kinds(spark, question, *records)] == want


def test_kinds_that_a_question_says_nothing_of_are_left_out(spark):
    assert set(kinds(spark, "meetings held", ("a", "b"))[0]) == {"share"}


def test_language_near_is_the_same_in_columns(spark):
    rng = random.Random(2)
    words = ["hindi", "english", "हिंदी", "received", "from", "replied", "in", "the", "letters", "and", "x"]
    rows = [[rng.choice(words) for _ in range(rng.randrange(0, 14))] for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, w array<string>")
    for actions in (rs.FROM, rs.REPLY):
        got = [r.l for r in df.select("i", rs.language_near_column(F.col("w"), actions).alias("l")).orderBy("i").collect()]
        assert got == [rs.language_near(r, actions) for r in rows] and len(set(got)) == 3


def test_the_best_record_is_the_one_that_a_reader_takes(spark):
    rows = [("Letters received in Hindi", "1. Letters received in Hindi", "Region A", False), ("Replied in Hindi", "1. Letters received in Hindi", "Region A", False), ("Replied in English", "1. Letters received in Hindi", "Region A", False), ("Reply not required", "1. Letters received in Hindi", "Region A", False), ("Total letters", "2. Letters sent", "To Region A", False), ("In Hindi", "2. Letters sent", "To Region A", False), ("Share in Hindi", "2. Letters sent", "To Region A", True)]
    df = spark.createDataFrame(rows, RECORD)

    def best(question, words):
        score = rs.record_score(question, words, *map(F.col, df.columns))
        return df.withColumn("s", score).orderBy(F.desc("s")).first().metric

    assert best("letters received in Hindi and replied in English", ["letters", "received", "hindi", "replied", "english"]) == "Replied in English"
    assert best("letters received in Hindi, reply not required", ["letters", "received", "hindi", "reply", "required"]) == "Reply not required"
    assert best("total letters sent to region A", ["total", "letters", "sent"]) == "Total letters"
    assert best("letters sent in Hindi", ["letters", "sent", "hindi"]) == "In Hindi" and best("percent of letters sent in Hindi", ["letters", "sent", "hindi"]) == "Share in Hindi"
    assert best("how many letters received in Hindi", ["letters", "received", "hindi"]) == "Letters received in Hindi"
    assert df.select(rs.record_score("x", [], *map(F.col, df.columns)).alias("s")).distinct().collect()[0].s == 0.0
