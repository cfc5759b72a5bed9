"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w . x), with one weight for each word shared by all thresholds, which
are kept in order. x says which words, and which prefixes of
words, of a bounded dictionary a text has once, twice or four times. The expected grade, as a share of
the highest, is the severity.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import wordgrams
from docloom.llm.common import bucket_of, chunks
from docloom.llm.sampling import labelled_texts

#: Training: rows of each grade, words of a row, dictionary words and the rows that each needs, passes.
PER_GRADE, ROW_WORDS, DICTIONARY, MIN_ROWS, EPOCHS = 2500, 4096, 60_000, 5, 400
PREFIXES = (5, 6, 7)
LEVELS = ((1, ""), (2, " 2"), (4, " 4"))
HELD_OUT = (5, 0)
_word = re.compile(rf"[^\W\d_]{{1,{wordgrams.PIECE}}}")


def _features(text: str | None) -> set[str]:
    """The words of a text and prefixes of them, marked by *; what comes two or four times is marked so as well."""
    words = Counter(_word.findall(text.lower())) if text else Counter()
    counts = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                counts[f"{w[:k]}*"] += n
    return {f"{w}{more}" for w, n in counts.items() for least, more in LEVELS if n >= least}


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    grades: list[int]
    dictionary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """(texts, grades)."""
        get, weights = self.dictionary.get, self.weights
        score = np.array([sum(weights[i] for w in _features(t) if (i := get(w)) is not None) for t in texts], np.float64)
        below = np.column_stack([np.zeros(len(texts)), _logistic(self.thresholds[None] - score[:, None]), np.ones(len(texts))])
        return np.diff(below, axis=1)


def train(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, penalty: float = 2e-3, rate: float = 0.3) -> Model | None:
    """The model from (text, grade) rows by full-batch Adagrad; None without rows."""
    grades = sorted({g for _, g in rows})
    if not grades:
        return None
    def features(text: str | None) -> set[str]:
        return _features(" ".join(w for run in wordgrams.spaced((text or "").split(), ROW_WORDS) for w in run))

    # most features are rare: a table of counts by hash tells which may reach MIN_ROWS, and only these are held
    counts = np.zeros(1 << 21, np.int32)
    for text, _ in rows:
        own = np.fromiter((zlib.crc32(f.encode()) for f in features(text)), np.uint32) & np.uint32(len(counts) - 1)
        counts[np.unique(own)] += 1
    seen: dict[str, int] = {}
    row, col = array("i"), array("i")
    for r, (text, _) in enumerate(rows):
        for f in sorted(features(text)):
            if counts[zlib.crc32(f.encode()) & (len(counts) - 1)] >= MIN_ROWS:
                row.append(r)
                col.append(seen.setdefault(f, len(seen)))
    row, col = np.array(row, np.int64), np.array(col, np.int64)
    held = np.bincount(col, minlength=len(seen))
    names = list(seen)
    chosen = sorted((i for i in range(len(names)) if held[i] >= MIN_ROWS), key=lambda i: (-held[i], names[i]))[:DICTIONARY]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    dictionary = {names[i]: j for j, i in enumerate(chosen)}
    row, col = (row[place[col] >= 0], place[col][place[col] >= 0]) if len(col) else (row, col)
    y, n, k = np.array([grades.index(g) for _, g in rows]), len(rows), len(grades)
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    w, thresholds = np.zeros(len(chosen)), np.log(share / (1 - share))
    # each grade weighs as much as any other
    weight = (n / k / np.bincount(y, minlength=k))[y]
    squares, high = [np.full(len(w), 5e-5), np.full(k - 1, 1e-6)], np.append(thresholds, np.inf)
    for _ in range(epochs if k > 1 else 0):
        score = np.bincount(row, w[col], n)
        high, low = np.append(thresholds, np.inf), np.append(-np.inf, thresholds)
        up, down = _logistic(high[y] - score), _logistic(low[y] - score)
        up[y == k - 1], down[y == 0] = 1.0, 0.0
        p = np.maximum(up - down, 1e-9)
        to_w = np.bincount(col, (weight * (up + down - 1))[row] * -1, len(w)) / n
        to_w = -to_w - penalty * np.sign(w) * 0.1 - penalty * w
        to_t = (np.bincount(y, weight * up * (1 - up) / p, k)[:-1] - np.bincount(y, weight * down * (1 - down) / p, k)[1:]) / n
        for table, g, s in ((w, to_w, squares[0]), (thresholds, to_t, squares[1])):
            s += g * g
            table += rate * g / np.sqrt(s)
        thresholds = np.maximum.accumulate(thresholds)
    w[np.abs(w) < 1e-3] = 0
    return Model(grades, {x: i for x, i in dictionary.items() if w[i]}, w, thresholds)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_grade: int = PER_GRADE) -> Model | None:
    """The model from labelled documents that are not held out, per_grade rows of each grade at most."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("grade")).filter("grade IS NOT NULL").distinct()
    known = known.filter(bucket_of(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])
    return train(labelled_texts(docs, known, "grade", per_grade))


def severities(docs: DataFrame, labels: DataFrame, label: str = "toxic", model: Model | None = None) -> DataFrame:
    """One row for each document: doc_id, held_out, severity (expected grade over the highest, 0 to 1), grade (the likeliest), toxic (severity >= 0.5).

    Null and empty texts have no words: the thresholds alone grade them. Without any label severity is 0; with
    one grade alone, each document has it. Every word of a text of any length is scored; of grades that tie the lower is
    the likeliest. Repeated rows give a row each; other columns are ignored, whatever their names; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, label))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            expected, grade = [], []
            for (texts,) in chunks([batch], columns=("text",)):
                p = own.probabilities(texts) if own else np.ones((len(texts), 1))
                grades = np.array(own.grades if own else [0])
                expected += np.clip(p @ grades / max(1, grades.max()), 0, 1).tolist()
                grade += grades[p.argmax(axis=1)].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(expected, pa.float64()), pa.array(grade, pa.int32()), pa.array([e >= 0.5 for e in expected], pa.bool_())], ["doc_id", "held_out", "severity", "grade", "toxic"])

    rows = docs.select("doc_id", (bucket_of(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, severity double, grade int, toxic boolean")
