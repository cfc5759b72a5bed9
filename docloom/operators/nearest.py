"""The nearest rows of many questions at once: blocks of rows meet blocks of questions, each pair is one matrix product."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and questions of a block, about; rows and questions of a product.
BLOCK_ROWS, BLOCK_QUESTIONS, TILE_ROWS, TILE_QUESTIONS = 8192, 4096, 1024, 1024
#: What a product may differ from a score that is added up in turn: rows this close are scored exactly.
SLACK = 1e-9


def _spread(n: int, most: int) -> int:
    return max(1, math.ceil(n / most))


def _vectors(table: pa.Table, column: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, vectors) for each width; width -1 are vectors that are null or hold a null."""
    held = pa.concat_arrays(table.column(column).chunks)
    sizes = np.asarray(held.value_lengths().fill_null(-1)).astype(int)
    flat = held.flatten()
    empty, flat = np.asarray(flat.is_null()), np.asarray(flat.fill_null(0.0))
    ends = np.cumsum(np.maximum(sizes, 0))
    begins = ends - np.maximum(sizes, 0)
    holes = np.concatenate([[0], np.cumsum(empty)])
    sizes[(holes[ends] - holes[begins]) > 0] = -1
    out = []
    for wide in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == wide)
        out.append((wide, at, flat[begins[at][:, None] + np.arange(wide)] if wide > 0 else np.zeros((len(at), 1))))
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for d in range(x.shape[1]):  # added up in turn, as the column expression does
        out += x[:, d] * x[:, d]
    return np.sqrt(out)


def _exact(x: np.ndarray, q: np.ndarray, nx: np.ndarray, nq: np.ndarray) -> np.ndarray:
    """vectors.cosine() of pairs, by the same additions in the same order."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[:, d]
    size = nx * nq
    return np.where(~(size <= 0), out / np.where(size == 0, 1.0, size), 0.0)  # NaN counts as above 0


def _best(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (question, id, score) of each question: by score, NaN first, then id."""
    order = np.lexsort((ids, -np.where(np.isnan(scores), np.inf, scores), at))
    at, ids, scores = at[order], ids[order], scores[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    return at[nth < k], ids[nth < k], scores[nth < k]


def _met(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows (place of the question, id, score) of each question, of one width, but for rows of the question's id."""
    nx, nq = _norms(x), _norms(q)
    with np.errstate(all="ignore"):
        ux, uq = x / np.where(nx == 0, 1.0, nx)[:, None], q / np.where(nq == 0, 1.0, nq)[:, None]
        found = []
        for b in range(0, len(q), TILE_QUESTIONS):
            cut = slice(b, b + TILE_QUESTIONS)
            best = (np.zeros(0, int), ids[:0], np.zeros(0))
            least = np.full(len(q[cut]), -np.inf)  # the k-th score so far
            for a in range(0, len(x), TILE_ROWS):
                tile = slice(a, a + TILE_ROWS)
                near = uq[cut] @ ux[tile].T
                near[np.isnan(near)] = np.inf
                near[own[cut][:, None] == ids[tile][None, :]] = -np.inf
                n = near.shape[1]
                floor = np.maximum(least, np.partition(near, n - k, axis=1)[:, n - k] if n > k else -np.inf)
                i, j = np.nonzero((near >= floor[:, None] - SLACK) & (near > -np.inf))
                scores = _exact(x[tile][j], q[cut][i], nx[tile][j], nq[cut][i]) if len(i) else np.zeros(0)
                best = _best(np.concatenate([best[0], i]), np.concatenate([best[1], ids[tile][j]]), np.concatenate([best[2], scores]), k)
                kth = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
                least[best[0][kth]] = np.where(np.isnan(best[2][kth]), np.inf, best[2][kth])
            found.append((best[0] + b, best[1], best[2]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _pairs(wide: int, x: np.ndarray, wide_q: int, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows and of the questions that have scores with each other; of other widths those with a vector that is null or 0."""
    rows, questions = np.arange(len(x)), np.arange(len(q))
    if wide == wide_q or -1 in (wide, wide_q):
        return [(rows, questions)]
    nx, nq = _norms(x), _norms(q)
    pairs = [(rows[nx == 0], questions[np.isfinite(nq)]), (rows[np.isfinite(nx) & (nx != 0)], questions[nq == 0])]
    return [(i, j) for i, j in pairs if len(i) and len(j)]


def nearest_each(rows: DataFrame, questions: DataFrame, k: int, row_id: str = "vec_id", question_id: str = "q", row_vector: str = "embedding", question_vector: str = "qv") -> DataFrame:
    """(question_id, row_id, score): the k nearest rows of every question by vectors.cosine(), but for rows of its id; ids are longs.

    A block of rows meets every block of questions, and gives the k best rows of each question; the k best of
    these are a question's. Products find what may be among the best, whose scores are then added up as the column
    expression does. Vectors of different widths have no score, but 0 where one is null or 0.
    """
    rows = rows.filter(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.col(row_vector).cast("array<double>").alias("v"))
    questions = questions.filter(F.col(question_id).isNotNull()).select(F.col(question_id).alias("id"), F.col(question_vector).cast("array<double>").alias("v"))
    a, b = _spread(rows.count(), BLOCK_ROWS), _spread(questions.count(), BLOCK_QUESTIONS)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = rows.withColumn("a", block(a)).withColumn("b", every(b)), questions.withColumn("b", block(b)).withColumn("a", every(a))
    schema = pa.schema([(question_id, pa.int64()), (row_id, pa.int64()), ("score", pa.float64())])

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        ids, own = np.asarray(x.column("id")), np.asarray(q.column("id"))
        out = [(own[:0], ids[:0], np.zeros(0))]
        for wide, at, v in _vectors(x, "v") if len(ids) and len(own) else []:
            for wide_q, at_q, w in _vectors(q, "v"):
                for i, j in _pairs(wide, v, wide_q, w):
                    x_, q_ = (v[i], w[j]) if wide == wide_q else (np.zeros((len(i), 1)), np.zeros((len(j), 1)))
                    place, row_ids, scores = _met(ids[at[i]], x_, own[at_q[j]], q_, k)
                    out.append((own[at_q[j]][place], row_ids, scores))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, f"{question_id} long, {row_id} long, score double")
