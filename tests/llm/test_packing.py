"""Packing against the tokenizer on whole texts and plain sums; edges; balance and padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.catalogue import op11_packing


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'.,!?|<>ABCxyzsdlvémÜß09́ 　\x01\x1c漢İΣ")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_remembered_words_give_the_tokenizers_ids(texts):
    coder = packing.word_ids(packing.TOKENIZER)
    ids, ends = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [e.ids for e in coder.whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["it's we'll .'s don't 'S", "a<|endoftext|>b <|startoftext|>", "word.\nNext!!word", "x  y z", "é ́e"])
def test_words_at_special_places(plain, text):
    coder = packing.word_ids(packing.TOKENIZER)
    assert coder.encode([text])[0].tolist() == ids_of(plain, text)[:-1]


def test_memory_of_words_begins_anew(plain, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    coder = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    for k in range(20):
        text = " ".join(f"word{k * j} {chr(97 + j)}x." for j in range(4))
        assert coder.encode([text])[0].tolist() == ids_of(plain, text)[:-1]
        assert len(coder.words) <= 5 + 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_windows_are_full_but_one(lengths):
    found = packing.packed(lengths, (64, 32, 16, 8))
    places = sorted((p, s, n) for _, own in found for p, s, n in own)
    covered = defaultdict(int)
    for p, s, n in places:  # each place once
        assert s == covered[p] and n > 0
        covered[p] += n
    assert [covered[i] for i in range(len(lengths))] == lengths
    assert sum(sum(n for _, _, n in own) != tier for tier, own in found) <= 1


def test_gaps_of_long_windows_are_filled_from_shorter_tiers():
    assert packing.packed([60, 4, 7], (64, 32, 16, 8)) == [(64, [(0, 0, 60), (1, 0, 4)]), (8, [(2, 0, 7)])]
    assert packing.packed([60, 7], (64, 32, 16, 8)) == [(64, [(0, 0, 60), (1, 0, 4)]), (8, [(1, 4, 3)])]
    assert [t for t, _ in packing.packed([8, 16, 32, 64], (64, 32, 16, 8))] == [64, 32, 16, 8]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([256, 512, 1024, 2048]), min_size=1, max_size=300), st.sampled_from([4096, 16384]))
def test_step_groups_differ_by_one_window_at_most(lengths, step):
    sums = defaultdict(int)
    for s, n in zip(packing.stepped(lengths, step), lengths, strict=True):
        sums[s] += n
    steps = max(1, round(sum(lengths) / step))
    if len(lengths) >= steps:
        assert len(sums) == steps and max(sums.values()) - min(sums.values()) <= 2048


def checked(rows, texts, plain, longest=2048):
    """Every id once, sequences gapless and no longer than the longest tier; (tokens, padded tokens)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, own in by_doc.items():
        want = ids_of(plain, texts[d])
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    total = padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= longest
        total, padded = total + at, padded + (at if at & (at - 1) == 0 else longest)
        assert {r.tier for r in own} == {at if at & (at - 1) == 0 else longest}
    assert set(by_doc) == set(texts)
    return total, padded


def test_query_over_the_documents(spark, plain):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total, padded = checked(op11_packing(spark, sf).collect(), texts, plain)
    assert padded < 1.01 * total


EDGES = {0: None, 1: "", 2: "a", 3: "word " * 9000, 4: "x" * 30_000, 5: "\x00 ́ İ ß", 6: "<|endoftext|> it's", 7: "same", 8: "same"}


def test_edges(spark, plain):
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in EDGES.items()], "doc_id long, text string, start long, group long, ids string")
    for parts in (1, 4):
        got = packing.pack(d.repartition(parts)).withColumn("ids_crc32", F.crc32("ids"))
        checked(got.collect(), EDGES, plain)
    assert packing.pack(d.filter("false")).collect() == []
    odd = spark.createDataFrame([(None, "one text"), (None, "one text"), ("k", "one text"), ("k", "one text")], "doc_id string, text string")
    rows = packing.pack(odd).collect()
    assert sum(r.length for r in rows) == 4 * len(ids_of(plain, "one text")) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_equal_rows_are_dealt_to_many_groups(spark):
    d = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"))
    rows = packing.pack(d, group_tokens=1000).groupBy((F.col("sequence_id") / 2**packing.SEQUENCE_BITS).cast("long")).agg(F.sum("length").alias("n")).collect()
    assert len(rows) > 10 and max(r.n for r in rows) < 2 * 1000 and sum(r.n for r in rows) == 3000 * 6


def test_little_padding_and_balanced_steps(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([(i, "the " * int(rng.lognormvariate(5, 1.3))) for i in range(1500)], "doc_id long, text string")
    rows = packing.pack(d, group_tokens=1 << 17, step_tokens=1 << 14).select("sequence_id", "step_group", "tier", "length").collect()
    steps, tiers = defaultdict(int), {}
    for r in rows:
        if r.sequence_id not in tiers:
            steps[r.step_group] += r.tier
        tiers[r.sequence_id] = r.tier
    assert sum(tiers.values()) < 1.02 * sum(r.length for r in rows)
    assert set(tiers.values()) >= {256, 512, 1024, 2048}
    by_group = defaultdict(list)
    for s, n in steps.items():
        by_group[s >> packing.SEQUENCE_BITS].append(n)
    assert all(max(v) - min(v) <= 2048 for v in by_group.values())
