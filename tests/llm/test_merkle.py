"""The manifest against a plain tree in memory; rounds of blocks, ties, nulls, hot trees, tampering."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import merkle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, at, changed):
    """(siblings, root from `changed`)."""
    found = []
    for row in tree[:-1]:
        low = at // 8 * 8
        run = row[low : low + 8]
        found += run[: at - low] + run[at - low + 1 :]
        changed, at = h(*run[: at - low], changed, *run[at - low + 1 :]), at // 8
    return found, changed


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
        trees[lang] = levels([x[2] for x in by[lang]])
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(by[lang]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            changed = h(*map(field, (*r[:4], r[4].translate(LOW) if bad and r[4] is not None else r[4])))
            low, folded = path(trees[lang], i, changed)
            high, folded = path(top, k, folded)
            out.append((r[0], leaf, trees[lang][-1][0], top[-1][0], h(*low, *high), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def made(spark, rows, parts=5, levels=merkle.LEVELS):
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string") if rows else spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.verified(merkle.manifest(d.selectExpr("*", "1 AS rank", "'x' AS tree", "2 AS size", "3 AS digest").repartition(parts), levels=levels))
    return sorted(map(tuple, got.collect()), key=str)


def many(n, langs=("en", "de", None)):
    return [(i * 7 - 20, f"s{i % 3}" if i % 5 else None, langs[i % len(langs)], i if i % 4 else None, f"Text Ünd {i}" if i % 6 else None) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 200])
def test_small_trees(spark, n):
    assert made(spark, many(n)) == brute(many(n))


def test_ties_nulls_empty_texts_and_repeated_rows(spark):
    rows = [*many(30), (5, "a", "en", 1, "B"), (5, "a", "en", 1, "B"), (5, "a", "en", 1, ""), (5, "a", "en", 1, None), (None, None, None, None, None), (None, None, None, None, None), (None, None, "", 0, ""), (3, "", "", 0, "Ä" * 100_000), (9, "x:y", "-", -1, "-")]
    assert made(spark, rows) == brute(rows)
    assert made(spark, []) == []


def test_rounds_of_blocks(spark, monkeypatch):
    for broadcast in (50_000, 0):
        monkeypatch.setattr(merkle, "BROADCAST_ROWS", broadcast)
        rows = many(700, ("en", "en", "en", "de", None, "fr"))
        assert made(spark, rows, levels=1) == brute(rows)


def test_blocks_of_many_languages(spark):
    rows = [(i, "s", f"l{i % 75}", 1, f"T{i}") for i in range(1500)] + [(5000 + i, "s", "l1", 1, "hot") for i in range(1300)]
    assert made(spark, rows) == brute(rows)


def test_a_language_of_equal_rows_is_split(spark):
    rows = [(1, "s", "en", 1, "Same")] * 3000 + many(50)
    assert made(spark, rows) == brute(rows)
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = d.select(F.lit("ven").alias("tree"), "doc_id", F.lit(b"x").alias("digest")).repartition(4)
    held = merkle.ranked(merkle.write_shared(leaves, "t"), F.col("doc_id"))
    assert sorted(r["rank"] for r in held.collect()) == list(range(3050))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 600), st.data())
def test_fold_undoes_traverse(n, data):
    digests = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
    top, paths = merkle.traverse(digests, merkle.height_of(n))
    assert top.hex() == levels([d.hex() for d in digests])[-1][0]
    i = data.draw(st.integers(0, n - 1))
    assert merkle.fold(digests[i], i, n, paths[i]) == top
    assert n == 1 or merkle.fold(b"x" * 32, i, n, paths[i]) != top


def test_tampering_is_found(spark):
    got = made(spark, many(90))
    bad = {r[0] for r in many(90) if zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4]}
    assert {r[0] for r in got if not r[6]} == bad and bad
