"""Scalar functions against hand-derived values."""

import uuid
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.functions import script, vectors
from docloom.functions import tokens as tk


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row.asDict(True)


def test_tokens_and_weights(spark):
    got = one(spark, t=tk.tokens(F.lit("Patra पत्र, X_1!")), o=tk.token_overlap(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcde"))), s=tk.lexical_score(F.lit("ab xab"), ["ab"]), w1=tk.sublinear(F.lit(1)), w2=tk.sublinear(F.lit(2)), w10=tk.sublinear(F.lit(10)), st=tk.search_terms(F.lit("Section 3(3) of 2024 act act")))
    assert got["t"] == ["patra", "पत्र", "x_1"]
    assert got["o"] == pytest.approx(0.613333, abs=1e-6)
    assert got["s"] == pytest.approx(2.3945, abs=1e-3)
    assert [got["w1"], got["w2"], got["w10"]] == [1.0, 1.6931, 3.3026]
    assert got["st"] == ["3(3)", "3", "2024", "section", "act"]


def test_ngrams_and_stems(spark):
    got = one(spark, g=tk.ngrams(F.split(F.lit("a b c"), " "), 2), s=tk.stem_overlap(["letter", "zz"], F.array(F.lit("letters"), F.lit("b"))), c=tk.content_tokens(F.split(F.lit("the letter 12 x of"), " "), ["the", "of"], {"letter": "पत्र"}))
    assert got["g"] == ["a", "b", "c", "a b", "b c"]
    assert got["s"] == 1 and got["c"] == ["पत्र"]


@pytest.mark.parametrize(("text", "value", "percent"), [("1,234.5 %", 1234.5, True), ("12**", 12.0, False), ("n/a", None, False), ("0", 0.0, False)])
def test_parse_number(spark, text, value, percent):
    v, p = nb.parse_number(F.lit(text))
    assert one(spark, v=v, p=p) == {"v": value, "p": percent}


def test_periods_and_labels(spark):
    got = one(spark, p=nb.period_text(F.lit("report_30.9.2024.docx")), k=nb.period_key(F.lit("30.09.2024")), m=nb.metric_key(F.lit("X (Total no. of letters)")), e=nb.edition(F.lit("mag_2023_2024.docx")), y=nb.year_of(F.lit("in 2021 and 2022 and 2022"), F.lit("x")), q=nb.quarter(F.lit("for Q3 quarterly")), u=nb.year_of(F.lit("none"), F.lit("mag_2019")))
    assert got == {"p": "30.09.2024", "k": {"y": 2024, "m": 9, "d": 30}, "m": "total no of letters", "e": "2024", "y": 2022, "q": "Q3", "u": 2019}


def test_states_and_types(spark):
    got = one(spark, a=nb.value_state(F.lit("")), b=nb.value_state(F.lit("N/A")), c=nb.value_state(F.lit("0")), t=F.array(*[nb.value_type(F.lit(x)) for x in ("40%", "30.09.2024", "1,200", "x")]), f=F.array(*[nb.format_number(F.lit(x).cast("double")) for x in (1.50, 2.0, None)]))
    assert got == {"a": "blank", "b": "not_applicable", "c": "present", "t": ["PERCENTAGE", "DATE", "NUMERIC", "TEXT"], "f": ["1.5", "2", "—"]}


def test_change_of_percent_rows_and_zero_bases(spark):
    rows = spark.createDataFrame([(270.0, 300.0, False), (86.0, 86.0, False), (99.0, 90.0, False), (75.0, 80.0, True), (0.0, 5.0, False)], "a double, b double, p boolean")
    d, pct = nb.change(F.col("a"), F.col("b"), F.col("p"))
    assert [tuple(r) for r in rows.select(d, pct).collect()] == [(30.0, 11.11), (0.0, 0.0), (-9.0, -9.09), (5.0, None), (5.0, None)]


def test_ids(spark):
    got = one(spark, u=nb.point_id(F.lit("doc_idx_0")), h=nb.token_hash(F.lit("पत्र")), r=nb.record_id(F.lit("a"), F.lit(None)))
    assert got["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc_idx_0"))
    assert got["h"] == zlib.crc32("पत्र".encode()) & 0x7FFFFFFF
    assert len(got["r"]) == 64


def test_scripts(spark):
    got = one(spark, s=F.array(*[script.script_of(F.lit(x)) for x in ("पत्र", "patra", "पत्र letter", "123")]), r=script.romanize(F.lit("पत्र")), n=script.nfkc(F.lit("ﬁ")), q=script.seq_ratio(F.lit("sunita"), F.lit("suneeta")), x=script.repair(F.lit("क ि  ख")))
    assert got["s"] == ["devanagari_hindi", "latin_english_or_hinglish", "mixed_hinglish", "neutral"]
    assert got["r"] == "patra" and got["n"] == "fi" and got["q"] == pytest.approx(0.769, abs=1e-3)
    assert script.same_person_text(script.person_key_text("Suneeta Arora"), script.person_key_text("Sunita Arora"))


def test_phonetic_matches_python(spark):
    for w in ("photo", "school", "wazeer", "ashwini"):
        assert one(spark, p=script.phonetic(F.lit(w)))["p"] == script.phonetic_text(w)


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    got = one(spark, a=vectors.cosine(v(1, 0), v(1, 1)), z=vectors.cosine(v(0, 0), v(1, 1)), q=vectors.cosine_to(v(3, 4), [3.0, 4.0]))
    assert got["a"] == pytest.approx(0.5**0.5) and got["z"] == 0 and got["q"] == pytest.approx(1)


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_title_score_is_bounded_and_reflexive(a, b):
    assert 0 <= script.title_score_text(a, b) <= 1
    if script.romanize_text(a):
        assert script.title_score_text(a, a) == 1
