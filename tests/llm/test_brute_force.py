"""Operators against brute force, and classifiers against held-out rows."""

import hashlib
import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import common, decontaminate, exact_dedup, jaccard_join, language_id, mixing, pii, quality, secrets_scan, substring_dedup, toxicity
from docloom.llm.graph import components, merged

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fastest(run, times=3):
    """Seconds of the fastest of some runs: what else the machine does counts little."""
    import time

    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return min(took)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- exact dedup


def test_directory_doubles():
    depth, directory, local = exact_dedup.double_directory({0: 5, 1: 1, 2: 1, 3: 1, 7: 9}, 3, 4)
    assert len(directory) == 2**depth and depth == 3
    for b, d in enumerate(local):
        assert directory.count(b) == 2 ** (depth - d)
    for cell in range(8):  # a cell's bucket holds cells that agree on its local depth
        b = directory[cell]
        assert {c >> (3 - local[b]) for c in range(8) if directory[c] == b} == {cell >> (3 - local[b])}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 63), st.integers(1, 9), max_size=64), st.integers(1, 40))
def test_buckets_are_key_ranges_within_capacity(cells, capacity):
    depth, directory, local = exact_dedup.double_directory(cells, 6, capacity)
    assert directory == sorted(directory) and set(directory) == set(range(len(local))) and max(local) == depth
    held = [sum(n for c, n in cells.items() if directory[c >> 6 - depth] == b) for b in range(len(local))]
    assert all(n <= capacity or d == 6 for n, d in zip(held, local, strict=True))
    total = sum(cells.values())
    assert total > capacity or len(local) == 1


@pytest.mark.parametrize(("key_bits", "hot"), [(60, 4096), (3, 4096), (60, 5), (3, 20)])
def test_exact_groups_with_and_without_collisions(spark, monkeypatch, key_bits, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(1)
    texts = [rng.choice(["Abc", "abc", "ÄB", "äb", "x", None, ""]) if i % 2 else f"Doc {i % 40}" for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs(spark, texts), capacity=4, key_bits=key_bits).collect()}
    norm = [(t or "").translate(LOW) for t in texts]
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(n.encode()).hexdigest())


def test_lookup_reads_the_bucket_that_the_directory_names(spark):
    d = docs(spark, [f"text {i % 90}" for i in range(200)])
    index = exact_dedup.build_index(d, capacity=4)
    assert len(index.local) > 8 and len(index.directory) == 2**index.depth
    for i in (0, 17, 89):
        one = exact_dedup.digests(d.filter(F.col("doc_id") == i)).withColumn("bucket", index.bucket()).first()
        assert one.bucket == index.directory[one.key >> 60 - index.depth]
        own = index.chains.filter((F.col("bucket") == one.bucket) & (F.col("key") == one.key))
        assert "PartitionFilters: [isnotnull(bucket" in own._jdf.queryExecution().toString()
        assert [(r.slot, r.text_sha256) for r in own.collect()] == [(0, one.text_sha256)]
    files = [f for f in index.chains.inputFiles() if "bucket=" in f]
    assert len(files) == len(index.chains.inputFiles()) == len({f.split("bucket=")[1].split("/")[0] for f in files})  # one owner, one file


def test_chains_hold_every_text_of_a_key(spark):
    index = exact_dedup.build_index(docs(spark, [f"text {i % 50}" for i in range(100)]), capacity=4, key_bits=3)
    slots = {}
    for r in index.chains.collect():
        slots.setdefault(r.key, []).append(r.slot)
    assert sum(map(len, slots.values())) == 50 and all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) <= 8


def test_exact_dedup_plan_is_native(spark):
    plan = exact_dedup.exact_groups(docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan.replace("LogicalRDD", ""))
    source = Path(exact_dedup.__file__).read_text()
    assert not re.search("udf|InPandas|InArrow|toPandas|toArrow|[.]rdd", source)


# --- decontamination


def brute_contamination(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = []
    for t in texts:
        w, hit, found = word.findall((t or "").translate(LOW)), set(), set()
        for item_id, text in items:
            i = word.findall((text or "").translate(LOW))
            n = min(window, len(i))
            wins = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(str(item_id))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_items_with_a_null_id_contaminate(spark):
    items = [(None, "one two three four"), (None, "five six seven"), (7, "five six seven")]
    got = decontaminate.contamination(docs(spark, ["x one two three four y", "five six seven", "eight"]), spark.createDataFrame(items, "item_id long, text string"), window=4).orderBy("doc_id").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [tuple(r)[1:] for r in got] == [(6, 4, 1, sha(""), True), (3, 3, 2, sha("7"), True), (1, 0, 0, sha(""), False)]


@pytest.mark.parametrize(("shard", "block"), [(400_000, 16_000_000), (17, 60)])
def test_contamination(spark, shard, block):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("ab Cé9") + rng.choice("xy") for _ in range(n))
    texts = [say(rng.randrange(60)) for _ in range(40)] + [None, "", "- ! -"]
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 14]))) for i in range(12)] + [(3, "zz"), (77, texts[0])]
    got = decontaminate.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=4, shard_words=shard, block_chars=block).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_contamination(texts, items, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=40), st.integers(1, 50))
def test_suffix_array(ids, depth):
    a = np.array(ids, np.int64)
    sa = decontaminate.suffix_array(a, depth)
    keys = [tuple(ids[i : i + depth]) for i in sa]
    assert sorted(sa.tolist()) == list(range(len(ids))) and keys == sorted(keys)


def test_longest_matches(spark):
    got = decontaminate.longest_matches(docs(spark, ["x y a b c d z", "a b c"]).coalesce(1), spark.createDataFrame([(9, "q a b c d")], "item_id long, text string"), min_words=3)
    assert {tuple(r) for r in got.collect()} == {(0, 2, "9", 1, 4), (0, 3, "9", 2, 3)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=0, max_size=30), min_size=1, max_size=4), st.lists(st.text("abcd", min_size=0, max_size=25), min_size=1, max_size=3), st.integers(1, 4))
def test_longest_matches_of_every_suffix(texts, items, window):
    shard = decontaminate.Shard()
    for i, t in enumerate(texts):
        shard.add(i, [c.encode() for c in t], 0, len(t), 0, len(t))
    block = decontaminate.Block.of([(str(i), " ".join(t)) for i, t in enumerate(items)])
    ids = np.array(shard.ids, np.int64)
    sa = decontaminate.suffix_array(ids, max(block.longest, window))
    ranks = np.array([shard.seen.get(w, -1) for w in block.vocabulary], np.int64)
    longest, position, lo, hi, width = decontaminate.search(ids, sa, block, ranks, window)
    flat, q = "|".join(texts) + "|", 0
    for t in items:
        for i in range(len(t)):
            want = max((n for n in range(len(t) - i + 1) if t[i : i + n] in flat), default=0)
            assert longest[q] == want and (not want or flat[position[q] : position[q] + want] == t[i : i + want])
            n = window if len(t) - i >= window else len(t) if i == 0 else 0
            places = {p for p in range(len(flat)) if n and flat.startswith(t[i : i + n], p)}
            assert width[q] == n and (not n or set(sa[lo[q] : hi[q]].tolist()) == places)
            q += 1


def test_a_long_verbatim_item_takes_linear_time():
    def prepared(n):
        words = [f"w{k}".encode() for k in range(n)]
        shard = decontaminate.Shard()
        shard.add(0, words, 0, n, 0, n)
        block = decontaminate.Block.of([("1", " ".join(w.decode() for w in words))])
        ids = np.array(shard.ids, np.int64)
        return ids, decontaminate.suffix_array(ids, n), block, np.array([shard.seen.get(w, -1) for w in block.vocabulary], np.int64), 10

    small, large = prepared(1000), prepared(4000)
    assert decontaminate.search(*large)[0].tolist() == list(range(4000, 0, -1))
    assert fastest(lambda: decontaminate.search(*large)) < 10 * fastest(lambda: decontaminate.search(*small)) + 0.05


# --- Jaccard join


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng, n):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(4, 120))] for _ in range(n // 6)]
    shared = [f"s{k}" for k in range(40)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        if rng.random() < 0.3:
            w = w[: len(w) // 3] + shared + w[len(w) // 3 :]
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return [*texts, None, "", "one two", "One  two", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("block", [1024, 4])
def test_components(spark, block):
    texts = near_copies(random.Random(4), 150)
    got = jaccard_join.similar_components(docs(spark, texts), block=block).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts)


def test_tree_finds_every_pair_that_may_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 60, np.uint64)) for _ in range(20)]
    sets += [np.unique(np.append(s[5:], rng.integers(0, 1 << 63, 4, np.uint64))) for s in sets]
    sizes = np.array([len(s) for s in sets])
    found = {tuple(sorted((int(i), int(j)))) for a, b, _ in jaccard_join.tree_pairs(sizes, [jaccard_join.bitmap(s) for s in sets], np.arange(len(sets))) for i, j in zip(a, b, strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 4 * both >= 3 * (sizes[i] + sizes[j] - both):
                assert (j, i) in found
    assert len(found) < 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11), st.integers(0, 5)), max_size=40), st.lists(st.integers(0, 11), min_size=12, max_size=12))
def test_a_spanning_forest_joins_what_all_candidates_join(edges, labels):
    i, j, score = (np.array([e[k] for e in edges], np.int64) for k in range(3))
    kept = jaccard_join.spanning(np.array(labels), i, j, score)
    assert len(kept) <= 11 and len(set(kept.tolist())) == len(kept)

    def groups(pairs):
        same = [(a, b) for a, b in itertools.combinations(range(12), 2) if labels[a] == labels[b]]
        up = list(range(12))
        for x, y in [*same, *pairs]:
            x, y = up[x], up[y]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    assert groups([(int(i[k]), int(j[k])) for k in kept]) == groups([(a, b) for a, b, _ in edges])


def one_group(rng, n):
    """Near copies of one text, some linked through others alone, and texts near to all that link with none."""
    base = [f"w{k}" for k in range(60)]
    texts = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3]) if i % 5 else 2):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 2])] = [f"e{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2]))]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("block", [1024, 16, 3])
def test_a_large_group_of_near_copies_loses_no_link(spark, block):
    texts = one_group(random.Random(9), 220) + near_copies(random.Random(10), 40)
    found = jaccard_join.similar_components(docs(spark, texts).repartition(3), block=block).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in found] == brute_components(texts)


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90


def test_merged_components(spark):
    labels = components(spark.createDataFrame([(5, 6), (8, 9), (6, 7)], "a long, b long"))
    got = {r.id: r.label for r in merged(labels, spark.createDataFrame([(7, 9), (2, 3), (5, 7)], "a long, b long")).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 2: 2, 3: 2}


# --- mixing


def test_targets_reshare_the_excess():
    got = mixing.targets([("a", 100), ("b", 1000), (None, 900)])
    assert got["a"] == 200 and sum(got.values()) == pytest.approx(3000) and got["b"] == pytest.approx(2 * got[None])


@pytest.mark.parametrize("block", [8192, 16])
def test_mix_meets_its_targets(spark, block):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(60))), rng.choice(["a", "b", "c", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=block).collect()
    again = mixing.mix(df.repartition(7), block=block).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    source = {i: s for i, _, s in rows}
    for s in ("a", "b", "c", None):
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and own[0].source_size == sum(r.size for r in own)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_sizes_and_targets_of_many_sources_equal_a_plain_loop(spark):
    rng = random.Random(15)
    names = [None, "", "a", "B", "b", "ä", "\U0001f600", "z z", *(f"host{i}.example" for i in range(40))]
    rows = [(i, rng.choice([" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(9))), None, "\t\n a\x0bb \u00a0c"]), rng.choice(names)) for i in range(600)]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    want = mixing.targets(list(total.items()))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert len(got) == 600
    for r in got:
        _, t, s = rows[r.doc_id]
        assert (r.size, r.source_size) == (size(t), total[s]) and r.target == pytest.approx(want[s], abs=1e-9) and r.taken <= 2 * r.size


def test_a_large_document_does_not_spoil_its_source(spark):
    rng = random.Random(16)
    rows = [(i, "w " * rng.randrange(20, 400), f"s{i % 6}") for i in range(240)] + [(1000 + k, "w " * 4000, f"s{k}") for k in range(6)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    for k in range(6):
        own = [r for r in got if source[r.doc_id] == f"s{k}"]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target


def test_mixed_rows_keep_columns_of_like_names(spark):
    rows = [(i, "w " * 30, "s", 7, "own", 5) for i in range(20)]
    got = mixing.mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copy string, mix_size int"))
    assert got.columns == ["doc_id", "text", "source", "size", "copy", "mix_size", "mix_mix_size", "source_size", "target", "taken", "mix_copy"]
    assert all(r.size == 7 and r.copy == "own" and r.mix_mix_size == 30 and 1 <= r.mix_copy <= 2 for r in got.collect())


def test_pivotal_rounding_is_unbiased():
    import pandas as pd

    p = pd.DataFrame({"size": [5, 3, 8, 2, 7], "open": [0.2, 0.9, 0.5, 0.4, 0.7], "copies": [0] * 5})
    runs = np.array([mixing._duel(p, random.Random(i), False)[["copies", "open"]].sum(axis=1) for i in range(4000)])
    assert np.abs(runs.mean(axis=0) - p["open"]).max() < 0.05


# --- PII and secrets

ALPHABET = "ab1.@+-() 0123456789.@%_Z\n:=\"'pf"


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=80))
def test_pii_base_equals_plain_expressions(t):
    assert pii.base_spans(t) == plain_pii(t)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_bootstrapping_discovers_identifiers_by_context(spark):
    texts = [f"some words here email: user{i}@mail{i}.example.com and more" for i in range(8)] + ["write to email: jane [at] site [dot] org today", "see jane [at] site [dot] org", "filler text " * 50]
    got = pii.personal_data(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_email for r in got] == [1] * 8 + [0, 0, 0] and got[8].n_added == 1 and got[9].n_added == 0
    kind, start, end = got[8].spans.split(":")
    assert texts[8][int(start) : int(end)] == "jane [at] site [dot] org"
    assert got[0].base_sha256 == hashlib.sha256(got[0].spans.encode()).hexdigest() and got[10].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_pattern_scores(spark):
    edges = [("L:mail", i, "email", 1) for i in range(4)] + [("L:mail", 9, None, 1), ("L:the", 1, "email", 1), ("L:the", 2, "email", 1), ("L:the", 3, "email", 1)]
    edges += [("R:x", i, None, 1) for i in (9, 10, 11, 12)] + [("L:to", i, None, 1) for i in (10, 11, 12, 13)] + [("L:mail", i, None, 1) for i in (11, 12)]
    totals = spark.createDataFrame([("L:mail", 8), ("L:the", 1000), ("R:x", 4), ("L:to", 4)], "pattern string, total long")
    score = lambda n: {r.pattern: r.confidence for r in pii.score_patterns(spark.createDataFrame(edges, "pattern string, instance long, kind string, n long"), totals, 1.2, 0.3, n).collect()}
    assert score(1) == {"L:mail": pytest.approx(4 / 8)}  # seeds alone
    assert score(2) == {"L:mail": pytest.approx((4 + 3 * 0.5) / 8), "R:x": pytest.approx(3 * 0.5 / 4)}  # what they discover supports a further pattern
    last = score(9)
    assert set(last) == {"L:mail", "R:x", "L:to"} and last["L:the"] < 0.01 if "L:the" in last else last["L:to"] > 0.3


@pytest.mark.parametrize(("parts", "most", "held"), [(1, 200_000, 200_000), (7, 200_000, 3), (7, 2, 200_000), (7, 0, 3)])
def test_pattern_totals_count_every_document(spark, parts, most, held):
    filler = "so much filler text " * 60_000  # a chunk of its own
    texts = [f"Near, u{i}@mail{i}.example.com here" for i in range(3)] + [f"{filler} (near) {i}" for i in range(4)] + ["near near", "and 12 near 345", None, ""]
    patterns = spark.createDataFrame([("L:near",), ("R:here",), ("L:0 near",), ("L:filler text near",), ("R:absent",)], "pattern string")
    totals = pii.pattern_totals(docs(spark, texts).repartition(parts), patterns, most, held)
    assert {r.pattern: r.total for r in totals.collect()} == {"L:near": 10, "R:here": 3, "L:0 near": 1, "L:filler text near": 4, "R:absent": 0}


def test_patterns_pass_by_what_they_match_in_all_documents(spark):
    texts = [f"Near, u{i}@mail{i}.example.com here" for i in range(3)] + ["near near near near", None, ""]
    assert set(pii.confident_patterns(docs(spark, texts))) == {"L:near", "R:here"}
    assert set(pii.confident_patterns(docs(spark, [*texts, "near " * 9]))) == {"R:here"}
    assert pii.confident_patterns(docs(spark, [texts[0]] * 5)) == {}  # one instance, five times


def test_bootstrapping_goes_from_pattern_to_pattern(spark):
    """Seeds support one pattern, what it discovers another, and that one finds identifiers that the seeds never met."""
    texts = [f"customer mailbox is u{i}@mail{i}.example.com ok{i}x" for i in range(6)]
    texts += [f"customer mailbox is jo{i} [at] site{i} [dot] org" for i in range(4)] + [f"reply address: jo{i} [at] site{i} [dot] org" for i in range(4)]
    texts += [f"reply address: ann{i} (at) home{i} (dot) net" for i in range(3)] + [f"see item jo{i} [at] site{i} [dot] com" for i in range(3)]
    got = pii.personal_data(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_added for r in got] == [0] * 6 + [1] * 11 + [0] * 3


@pytest.mark.parametrize("most", [10_000, 0])
def test_planted_identifiers_are_discovered(spark, most):
    """Unseen identifiers behind the contexts of seeds are found, and numbers elsewhere are left alone."""
    rng = random.Random(12)
    word = lambda: rng.choice("river stone house green paper light table moving window under".split()) + rng.choice(["", "s", "ed"])
    say = lambda n: " ".join(word() for _ in range(n))
    seeds = {"email": lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(99)}.example.com", "phone": lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4))}
    loose = {"email": lambda: f"{word()}{rng.randrange(99)} [at] host{rng.randrange(99)} [dot] org", "phone": lambda: f"555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}", "ip": lambda: ":".join(f"{rng.randrange(1 << 16):04x}" for _ in range(8)) + "1"}
    context = {"email": ["write to me at", "my mailbox is", "e-mail:"], "phone": ["call me on", "phone number", "ring"], "ip": ["logged in from", "host address", "client"]}
    texts, planted, clean = [], {}, set()
    for i in range(600):
        kind, what = rng.choice(list(seeds)), i % 3
        own = f"{rng.choice(context[kind])} {(seeds if what == 0 else loose)[kind]()}" if what < 2 else f"{word()} {loose[kind]()}"
        texts.append(f"{say(20)} {own} {say(20)}")
        if what == 1:
            planted[i] = kind
        elif what == 2:
            clean.add(i)
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, texts), most=most).collect()}
    found = [i for i, kind in planted.items() if any(s.startswith(kind) for s in got[i].spans.split(","))]
    wrong = [i for i in clean if got[i].n_added]
    assert len(found) >= 0.9 * len(planted) and len(wrong) <= 0.05 * len(clean)


def test_patterns_over_the_bound_are_joined(spark):
    texts = [f"{w} user{i}@mail{i}.example.com {w}x and +1 555 010 00{i}{i} 10.0.0.{i}" for i in range(4) for w in ("mail:", "post:", "write")]
    texts += ["mail: jane [at] site [dot] org", "post: jane [at] site [dot] org b@c.de, write jo [at] site [dot] org writex", "see jane [at] site [dot] org", None, ""]
    d = docs(spark, texts)
    d = d.union(d.filter("doc_id = 12")).union(spark.createDataFrame([(None, texts[12])], d.schema))
    want = sorted(map(str, pii.personal_data(d).collect()))
    assert sum("n_added=1" in r for r in want) == 3 and sum("n_added=2" in r for r in want) == 1
    for most in (0, 1, 2):
        assert sorted(map(str, pii.personal_data(d, most=most).collect())) == want


@settings(max_examples=300, deadline=None)
@given(st.text("a1.@+-() [:'", max_size=60))
def test_loose_spans_touch_nothing(t):
    base = pii.base_spans(t)
    spans = pii.loose_spans(t, base)
    assert spans == sorted(spans) and all(a < b and t[a:b].strip() == t[a:b] for a, b in spans)
    assert all(b <= c for (_, b), (c, _) in itertools.pairwise(spans)) and not any(s < b and a < e for _, s, e in base for a, b in spans)


def test_many_entities_in_one_text_take_linear_time():
    def run(n):
        text = " ".join(f"mail u{i}@x{i}.de or 555 {i:06d} or {i} [at] b{i}" for i in range(n))
        pii.all_spans(text, {"L:or": [("phone", 1.0)]})
        secrets_scan.added_spans(text.replace(" ", "_token = "), [("assign", i, i + 1) for i in range(0, n * 10, 10)])

    assert fastest(lambda: run(16_000), 2) < 12 * fastest(lambda: run(4000), 2)


WORDS = ["password", "secret", "api_key", "apikey", "TOKEN", "passwd", "AKIA", "deadbeef" * 4, "=", ":", " ", '"', "'", "abc12345", "x", "0f", "AKIAABCDEFGH12345", "ſecret", "toKen"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=12))
def test_secret_base_equals_plain_expressions(parts):
    t = "".join(parts)
    want = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    assert secrets_scan.base_spans(t) == sorted(want, key=lambda s: (s[1], secrets_scan.KINDS.index(s[0])))


@pytest.mark.parametrize(("text", "found"), [
    ('k = "s3cr3tValue99x"\ndb_password = k', ["s3cr3tValue99x"]),
    ('part = "aaaa1111"\nother = "zzzz9999y"\napi_key_full = part + "bbbb2222c"', ["aaaa1111", "bbbb2222c"]),
    ("<authToken>zz99yy88xx77</authToken>", ["zz99yy88xx77"]),
    ('title: "abcdefgh12345"\nnote = plain', []),
    ("password_hint = changeme", []),
])
def test_lexing_adds_literals_by_name(text, found):
    spans = secrets_scan.added_spans(text, secrets_scan.base_spans(text))
    assert sorted(text[s:e] for _, s, e in spans) == found


@pytest.mark.parametrize(("text", "found"), [
    ('{"db": {"user": "bob", "password_hash": "s3cr3tValue99x"}}', ["s3cr3tValue99x"]),
    ("tokens:\n  github: gH7xPq92LmZt4\nother:\n  github: gH7xPq92LmZt5", ["gH7xPq92LmZt4"]),
    ("[credentials]\nmain = Zx81kkQ9plm\n[colours]\nmain = Zx81kkQ9plo", ["Zx81kkQ9plm"]),
    ('# old_auth_pwd = "q1w2e3r4t5y6"\nx = 1', ["q1w2e3r4t5y6"]),
    ('/* k = "aaaa1111bb" */ auth_pwd = k', []),
    ('def a():\n    k = "aaaa1111bb"\nauth_pwd = k', []),
    ('k = "aaaa1111bb"\ndef a():\n    auth_pwd = k', ["aaaa1111bb"]),
    ('k = "aaaa1111bb"; f() { k = "cccc3333dd"; auth_pwd = k }', ["cccc3333dd"]),
    ('auth_pwd = "quo\\"ted1x9" + more', ['quo\\"ted1x9']),
    ("auth_pwd: str = 'zz99yy88xx77'", ["zz99yy88xx77"]),
    ("private_key: |\n  -----BEGIN KEY-----\n  MIIEabcd1234EFGH5678ijkl\n  MIIEabcd1234EFGH5678ijkm\n  -----END KEY-----\nnext: 1", ["-----BEGIN KEY-----\n  MIIEabcd1234EFGH5678ijkl\n  MIIEabcd1234EFGH5678ijkm\n  -----END KEY-----"]),
    ("SIGNING_KEY=$(cat <<EOF\nq1w2\nEOF\n)\nAUTH_PWD=<<EOF\nzz99yy88xx77\nEOF\n", ["zz99yy88xx77"]),
    ("curl -H 'x' --auth-pwd=zz99yy88xx77 -pw qq99yy88xx77 -v", ["zz99yy88xx77", "qq99yy88xx77"]),
    ('client.set_auth_pwd("zz99yy88xx77"); m.put("auth_pwd", "qq99yy88xx77"); m["auth_pwd"] = "rr99yy88xx77"', ["zz99yy88xx77", "qq99yy88xx77", "rr99yy88xx77"]),
    ("Authorization_Key: Bearer zz99yy88xx77", ["zz99yy88xx77"]),
    ("see https://bob:zz99yy88xx77@host/path", ["zz99yy88xx77"]),
    ('<server auth_pwd="zz99yy88xx77"><authKey>qq99yy88xx77</authKey></server>', ["zz99yy88xx77", "qq99yy88xx77"]),
    ("don't use my auth: it isn't there, key: value, that's all", []),
    ('auth_key = get_auth_key\ntoken_type = "access_token"', []),
])
def test_lexer_reads_many_kinds_of_syntax(text, found):
    assert sorted(text[s:e] for _, s, e in secrets_scan.added_spans(text, secrets_scan.base_spans(text))) == sorted(found)


def test_planted_secrets_are_found_and_other_literals_left():
    rng = random.Random(3)
    value = lambda: "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(rng.randrange(12, 300)))
    bad = ["auth_pwd", "signingKey", "db.credentials", "PASSPHRASE", "bearerAuth", "private-access-key", "encryptionKey"]
    good = ["title", "colour", "commit", "build_id", "path", "etag"]
    forms = ['{n} = "{v}"', "{n}: {v}", '{{"{n}": "{v}"}}', "export {n}={v}", "--{n} {v}", "<{n}>{v}</{n}>", "x = '{v}'\n{n} = x", 'call("{n}", "{v}")', "{n}: |\n  {v}\n", '{n} = """{v}"""', "{n} <- 1\n{n} = <<END\n{v}\nEND"]
    say = lambda: " ".join(rng.choice("some words stand here and there with".split()) for _ in range(8))
    hit = wrong = 0
    for i in range(400):
        v, secret = value(), i % 2 == 0
        text = f"{say()}.\n{rng.choice(forms).format(n=rng.choice(bad if secret else good), v=v)}\n{say()}"
        base = secrets_scan.base_spans(text)
        spans = base + secrets_scan.added_spans(text, base)
        got = any(text[s:e] == v for _, s, e in spans)
        hit, wrong = hit + (got and secret), wrong + (bool(spans) and not secret)
    assert hit >= 0.95 * 200 and wrong <= 0.02 * 200


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["pwd", "key", "a", "=", ":", " ", "\n", "  ", '"', "'", "`", '"""', "{", "}", "(", ")", "[", "]", "<", ">", "/", "<<E\n", "E", "|", "+", "\\", "#", "//", "/*", "*/", "<!--", "-->", "--", "q1w2e3r4t5", "$x", ","]), max_size=40))
def test_lexer_takes_any_text(parts):
    t = "".join(parts)
    assert all(t[a:b] == literal and names for literal, (a, b), names in secrets_scan.literals(t))
    base = secrets_scan.base_spans(t)
    added = secrets_scan.added_spans(t, base)
    assert not any(s < e2 and s2 < e for _, s, e in added for _, s2, e2 in base) and all(x[2] <= y[1] for x, y in itertools.pairwise(added))


@pytest.mark.parametrize("unit", ["/* ", "<!-- ", '"', "<<A{i}\n", "key: ", "key = (", "{", "a.b.c", "<a ", "x" * 50, "key: |\n  a\n", "(key = ", "[", "'"])
def test_lexing_takes_linear_time(unit):
    text = lambda n: "pwd " + "".join(unit.replace("{i}", str(i)) for i in range(n))
    assert fastest(lambda: secrets_scan.literals(text(6000))) < 12 * fastest(lambda: secrets_scan.literals(text(1500))) + 0.05


def test_long_literals_are_found_whole():
    long = "aB3" * 300 + "+/"
    for text in (f"<api_token>{long}</api_token>", f"run --api-token {long} now"):
        assert [text[s:e] for _, s, e in secrets_scan.added_spans(text, secrets_scan.base_spans(text))] == [long]


# --- substring dedup


def test_repeated_passages_stay_once(spark):
    passage = "One sentence of the passage has quite a few words here. Another sentence of it follows with more words. A third one ends it now."
    texts = [f"Own words of zero are here. {passage} End zero.", f"Own words of one are here. {passage} End one.", "Nothing repeated in this text. Not even a bit of it.", f"{passage}", "Short. Same. Short. Same."]
    got = substring_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 3, 0, 3, 0]
    assert got[0].text == texts[0] and got[1].text == "Own words of one are here. End one." and got[3].text == "" and got[2].text == texts[2]


@pytest.mark.parametrize(("sample", "hot"), [(64, 8), (1, 1), (2, 3)])
def test_substring_dedup_equals_a_plain_loop(spark, monkeypatch, sample, hot):
    """Runs of whole sentences (short ones, so that none is cut), the first place of each kept, hot runs or not."""
    monkeypatch.setattr(substring_dedup, "SAMPLE", sample)
    monkeypatch.setattr(substring_dedup, "HOT_SAMPLED", hot)
    rng = random.Random(11)
    pool = [" ".join(rng.choice("one two three four five six".split()) for _ in range(rng.randrange(1, 9))) + "." for _ in range(60)]
    texts = [" ".join(pool[(at := rng.randrange(60)) : at + rng.randrange(1, 9)]) for _ in range(120)] + [None, "", "x"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[0]), (None, texts[0])]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    first, gone = {}, {}
    for i, t in enumerate(texts):
        sents = (t or "").replace(". ", ".|").split("|") if t else []
        for a in range(len(sents)):
            words, b = 0, a
            while b < len(sents) and (b - a < 2 or words < 12):
                words += len(sents[b].split())
                b += 1
            if b - a >= 2 and words >= 12:
                if first.setdefault(tuple(" ".join(sents[a:b]).split()), (i, a)) != (i, a):
                    gone.setdefault(i, set()).update(range(a, b))
    for r in got:
        t = r.text
        if r.doc_id is None:
            assert t == texts[0] and r.n_removed == 0
            continue
        sents = (texts[r.doc_id] or "").replace(". ", ".|").split("|") if texts[r.doc_id] else []
        assert r.n_removed == len(gone.get(r.doc_id, ())) and (t or "").split() == [w for k, s in enumerate(sents) if k not in gone.get(r.doc_id, ()) for w in s.split()]
    assert sum(map(len, gone.values())) > 100


@settings(max_examples=150, deadline=None)
@given(st.text("ab .!?\n", max_size=120), st.integers(1, 5))
def test_sentences_tile_the_text(t, piece):
    found = substring_dedup.sentences(t, piece)
    assert "".join(t[a:b] for a, b, _ in found) == (t if t.split() else "") and all(1 <= n <= piece for *_, n in found)
    assert sum(n for *_, n in found) == len(t.split())


@pytest.mark.parametrize(("stops", "size"), [(0, 5000), (0.04, 5000), (0.1, 5000), (0.3, 5000), (0, 12)])
def test_passages_of_51_words_are_found_wherever_they_begin(stops, size):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(size)}" + "." * (rng.random() < stops) for _ in range(n)]
    for _ in range(150):
        passage = say(51)
        pair = [" ".join([*say(rng.randrange(60)), *passage, *say(rng.randrange(60))]) for _ in range(2)]
        assert {d for _, d in substring_dedup.runs(pair[0])} & {d for _, d in substring_dedup.runs(pair[1])}


def test_passages_mid_sentence_and_without_blanks_are_removed(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(n))
    passage, text = say(60), han(60)
    texts = [f"{say(7)} {passage} {say(5)}", f"Stop here. {passage}. Then {say(9)}", f"{say(40)} {passage} {say(33)}", han(9) + text + han(20), han(30) + text, say(200), han(200)]
    got = {r.doc_id: r for r in substring_dedup.dedup(docs(spark, texts).repartition(5)).collect()}
    for i, t in enumerate(texts):
        gone = [tuple(map(int, s.split(":"))) for s in got[i].removed.split(",") if s]
        copy = passage if passage in t else text
        assert bool(gone) == (i in (1, 2, 4)) and all(t[a:b].strip(". ") in copy for a, b in gone)
        assert not gone or sum(b - a for a, b in gone) > len(copy) / 5


# --- classifiers


def test_code_switched_documents_stay(spark):
    # three languages in equal parts: no mean probability is near 0.4
    own = {lang: [f"{lang}{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)] for lang in ("qa", "xo", "vu")}
    rng = random.Random(8)
    rows = [(" ".join(rng.choices(words, k=40)), lang) for lang, words in own.items() for _ in range(40)]
    chain = language_id.train(rows)
    mixed = " ".join(" ".join(rng.choices(words, k=30)) for words in own.values())
    (lang, score), = language_id.predict(chain, [mixed])
    assert lang != language_id.UNKNOWN and score < 0.4
    assert [r.doc_id for r in language_id.recognised_rows(docs(spark, [mixed, "123 !!", None]), chain=chain).collect()] == [0]


def language_rows(n, seed):
    rng = random.Random(seed)
    parts = {"en": ["th", "ing", "er", "tion"], "de": ["sch", "ung", "keit", "ö"], "fr": ["eau", "que", "é", "oi"]}
    return [(" ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang) for lang in parts for _ in range(n)]


def test_language_model_on_held_out_rows():
    chain = language_id.train(language_rows(60, 1))
    rows = language_rows(20, 2)
    got = language_id.predict(chain, [t for t, _ in rows])
    assert np.mean([lang == want for (lang, _), (_, want) in zip(got, rows, strict=True)]) >= 0.95
    assert language_id.predict(chain, [None, "", "123 !"]) == [("und", 0.0)] * 3
    mixed = language_id.word_languages(chain, "thing ertion thering ingth schung keitsch ungkeit schkeit")
    assert [x[1] for x in mixed] == ["en"] * 4 + ["de"] * 4


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    scores, moves, starts = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, pairs = language_id.forward_backward(scores, np.ones((4, 1), bool), moves, starts)
    want, total, moved = np.zeros((4, 3)), 0.0, np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(starts[path[0]] + sum(scores[t, 0, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += w
        for t, y in enumerate(path):
            want[t, y] += w
        for a, b in itertools.pairwise(path):
            moved[a, b] += w
    assert np.allclose(p[:, 0], want / total) and np.allclose(pairs, moved / total)


def test_scoring_equals_forward_backward():
    rng = np.random.default_rng(2)
    scores, there = rng.normal(size=(7, 5, 3)), np.arange(7)[:, None] < np.array([7, 1, 3, 5, 2])[None, :]
    chain = language_id.Chain(["a", "b", "c"], np.zeros((1, 3)), {}, np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    want, _ = language_id.forward_backward(scores, there, chain.moves, chain.starts)
    got = language_id._marginals(np.where(there[:, :, None], scores, 0.0).astype(np.float32), there, chain)
    assert np.abs(got[there] - want[there]).max() < 1e-5


def test_quality_model_on_held_out_rows():
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["river", "house", "walks", "slowly", "green", "the"]) for _ in range(40))
    bad = lambda: rng.choice([" ".join(w + "$$$" for w in good().split()), " ".join([rng.choice(["zed", "kap", "lum"])] * 40)])
    model = quality.train([(good(), 1) for _ in range(150)] + [(bad(), 0) for _ in range(60)], epochs=6)
    rows = [(good(), 1) for _ in range(40)] + [(bad(), 0) for _ in range(40)]
    p = model.probabilities([t for t, _ in rows])[:, 1]
    assert np.mean((p >= 0.3) == np.array([y for _, y in rows])) >= 0.95
    assert quality.train([]) is None and 0 <= model.probabilities([None])[0, 1] <= 1


def test_ordinal_grades():
    rng = random.Random(4)
    words = {1: "rude", 2: "nasty", 3: "vile"}
    make = lambda g: " ".join([rng.choice(["a1", "calm", "day", "tree", "sky"]) for _ in range(20)] + [words[g]] * (g > 0))
    words[0] = ""
    model = toxicity.train([(make(g), g) for g in range(4) for _ in range(120)])
    rows = [(make(g), g) for g in range(4) for _ in range(30)]
    p = model.probabilities([t for t, _ in rows])
    expected = p @ np.arange(4)
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(model.thresholds) >= 0).all()
    assert np.mean(p.argmax(axis=1) == np.array([g for _, g in rows])) >= 0.9
    means = [expected[i * 30 : i * 30 + 30].mean() for i in range(4)]
    assert means == sorted(means)
