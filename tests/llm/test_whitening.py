"""Whitening against the eigenvectors of the covariance, in exact integers where exact ones are asked for; edges."""

import math
from fractions import Fraction

import numpy as np
import pytest

from docloom.llm import whitening
from docloom.llm.catalogue import op12_whitening


def brute(vectors):
    """(x by row or None, n, sums, eigenvalues, vectors, trace) of the fit list."""
    xs = [None if v is None or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    once = np.array(sorted({x for x in xs if x is not None}), float)
    centred = once - once.mean(axis=0)
    values, right = np.linalg.eigh(centred.T @ centred / len(once))
    return xs, len(once), [sum(int(v) for v in c) for c in once.T], values[::-1], right.T[::-1], values.sum()


def compared(rows, ids, vectors, components=4):
    xs, n, sums, values, right, trace = brute(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append(r)
    assert set(got) == {i for i, x in zip(ids, xs, strict=True) if x is not None}
    signs = {}
    for i, x in zip(ids, xs, strict=True):
        if x is None:
            continue
        own = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, components + 1))
        for k, r in enumerate(own):
            assert r.n == n and int(r.deviation) == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
            assert abs(r.explained - values[k] / trace) <= 1e-9
            want = float((np.array([float(c - Fraction(s, n)) for c, s in zip(x, sums, strict=True)]) @ right[k]) / math.sqrt(values[k]))
            if abs(want) > 1e-3:
                assert signs.setdefault(k, math.copysign(1, want * r.whitened)) == math.copysign(1, want * r.whitened)
            assert abs(abs(r.whitened) - abs(want)) < 1e-7
            assert r.identity_error < 1e-9


def test_query_over_the_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    compared(op12_whitening(spark, sf).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_against_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, v)) for v in rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2] + 9]
    vectors += [vectors[0]] * 200 + [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] * 6, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], [-0.0] * 6, [1.0] * 5]
    d = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS n", "3 AS node").repartition(9)
    compared(whitening.whiten(d).collect(), range(len(vectors) - 1), vectors[:-1])  # the short vector is left out


def test_tree_of_many_tasks_is_one_qr(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-900, 900, (600, 5))
    rows = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(70)
    merge = lambda s: whitening.triangle(np.vstack([m.reshape(-1, 5) for m in s]))
    r = whitening._tree(rows, 5, lambda blocks: whitening.triangle(np.vstack([np.zeros((0, 5)), *blocks]).astype(float)), merge).reshape(-1, 5)
    assert np.allclose(r.T @ r, x.T @ x)


def test_no_covariance_means_no_loss_of_small_components(spark):
    """Spreads of 1e-9 of the largest are found: the squares in a covariance would be below its rounding."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**40), 2**40, 200), rng.integers(-200, 200, 200)
    rows = spark.createDataFrame([([int(p), int(p) + int(q)],) for p, q in zip(a, b, strict=True)], "x array<long>")
    model, _ = whitening.fit(rows)
    u, v = (a - b * 0).astype(object), b.astype(object)
    n = len(a)
    gram = lambda p, q: Fraction(n * sum(p * q) - sum(p) * sum(q), n * n)
    det = gram(u, u) * gram(u + v, u + v) - gram(u, u + v) ** 2
    assert abs(model.values[1] / float(det / (gram(u, u) + gram(u + v, u + v))) - 1) < 1e-4


def test_exact_beyond_64_bits(spark):
    d = spark.createDataFrame([(i, [float(i) * 2.0**40, -3.0]) for i in range(40)], "vec_id long, embedding array<double>")
    xs = [[math.floor(256 * c) for c in (i * 2.0**40, -3.0)] for i in range(40)]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    got = {r.vec_id: r for r in whitening.whiten(d).filter("component = 1").collect()}
    for i, x in enumerate(xs):
        want = sum((40 * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert got[i].deviation is None if want >= 10**38 else int(got[i].deviation) == want


def test_edges(spark):
    one = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert one([]).collect() == [] and one([(1, None), (2, [None]), (3, [])]).collect() == []
    alone = one([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]).collect()
    assert len(alone) == 6 and all(r.n == 1 and r.whitened is None and r.deviation == 0 and r.identity_error is None and r.explained is None for r in alone)
    flat = one([(i, [float(i), 5.0]) for i in range(6)]).collect()
    assert {r.whitened is None for r in flat if r.component == 2} == {True} and all(r.identity_error < 1e-9 for r in flat)
    assert one([(1, [1.0])]).schema["deviation"].dataType.simpleString() == "decimal(38,0)"


@pytest.mark.parametrize("parts", [1, 7])
def test_however_rows_lie(spark, parts):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(200, 3)) * [4, 2, 1]).tolist()
    d = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").repartition(parts)
    compared(whitening.whiten(d, components=3).collect(), range(200), v, 3)
