"""Quality classifier: supervised subword embeddings.

Words between blanks, their character n-grams and their word bigrams are hashed to learned vectors. The
vectors of a document are averaged, and a softmax layer gives its class. Everything is trained by stochastic
gradient descent in numpy, on a bounded sample of labelled rows. A bigram of a word with itself is one
feature for all words, so that repetition shows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import wordgrams
from docloom.llm.common import bucket_of, chunks
from docloom.llm.sampling import labelled_texts

TABLE, DIM = 1 << 17, 8
#: Training: rows of each class, words of a row, passes.
PER_CLASS, ROW_WORDS, EPOCHS = 2500, 320, 4
HELD_OUT = (5, 0)
THRESHOLD = 0.3
REPEATED = 0  # the feature of a word after itself
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _columns(codes: np.ndarray, lengths: np.ndarray):
    """The whole word, and n-grams of 2 to 4 characters with its ends marked."""
    h = np.ones(len(codes), np.uint64)
    for i in range(codes.shape[1]):
        h = np.where(i < lengths, wordgrams.mixed(h + codes[:, i]), h)
    yield (1 + h % np.uint64(TABLE - 1)).astype(np.int64)[:, None], np.ones((len(codes), 1), bool)
    for index, there in wordgrams.grams(codes, lengths, 2, 4, TABLE - 1):
        yield 1 + index, there


def _bigrams(numbers: np.ndarray, owner: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, documents) of the bigrams of words in turn."""
    h = np.zeros(len(words), np.uint64)
    for own, codes, lengths in wordgrams.slabs(words):
        x = np.full(len(codes), 7, np.uint64)
        for i in range(codes.shape[1]):
            x = np.where(i < lengths, wordgrams.mixed(x + codes[:, i]), x)
        h[own] = x
    a, b = numbers[:-1], numbers[1:]
    same = owner[:-1] == owner[1:]
    pair = (1 + wordgrams.mixed(h[a] * _PAIR + h[b]) % np.uint64(TABLE - 1)).astype(np.int64)
    return np.where(a == b, REPEATED, pair)[same], owner[1:][same]


@dataclass
class Model:
    classes: list
    vectors: np.ndarray  # TABLE x DIM
    output: np.ndarray  # DIM x classes
    bias: np.ndarray

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """(texts, classes); a text without words has the bias alone."""
        scores = (self.vectors @ self.output).astype(np.float64)
        words, numbers, sizes = wordgrams.numbered([wordgrams.blank_words(t or "") for t in texts])
        owner, n = np.repeat(np.arange(len(texts)), sizes), len(texts)
        word_sum, word_count = wordgrams.weighed(words, _columns, scores)
        pairs, of = _bigrams(numbers, owner, words)
        count = np.bincount(owner, word_count[numbers], n) + np.bincount(of, minlength=n)
        out = np.zeros((n, len(self.classes)))
        for c in range(out.shape[1]):
            out[:, c] = (np.bincount(owner, word_sum[numbers, c], n) + np.bincount(of, scores[pairs, c], n)) / np.maximum(count, 1)
        out = np.exp(out + self.bias - (out + self.bias).max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str | None, object]], epochs: int = EPOCHS, batch: int = 64, seed: int = 5, rate: float = 1.5) -> Model | None:
    """The model from (text, class) rows; None without rows."""
    classes = sorted({y for _, y in rows})
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    texts = [[w for run in wordgrams.spaced(wordgrams.blank_words(t or ""), ROW_WORDS) for w in run] for t, _ in rows]
    label = np.array([classes.index(y) for _, y in rows])
    words, numbers, sizes = wordgrams.numbered(texts)
    owner = np.repeat(np.arange(len(rows)), sizes)
    of_word, feature = wordgrams.listed(words, _columns)
    bounds = np.searchsorted(of_word, np.arange(len(words) + 1))
    pairs, pair_of = _bigrams(numbers, owner, words)
    begin, pair_begin = np.append(0, np.cumsum(sizes)), np.searchsorted(pair_of, np.arange(len(rows) + 1))
    k = len(classes)
    model = Model(classes, rng.uniform(-0.1, 0.1, (TABLE, DIM)), np.zeros((DIM, k)), np.log(np.bincount(label, minlength=k) / len(label)))
    model.output[:] = rng.normal(0, 0.3, (DIM, k))
    squares = [np.full((TABLE, DIM), 1e-6), np.full((DIM, k), 1e-3)]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            features, docs = [], []
            for j, r in enumerate(own):
                w = numbers[begin[r] : begin[r + 1]]
                size = bounds[w + 1] - bounds[w]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[w], size)
                both = np.concatenate([feature[place], pairs[pair_begin[r] : pair_begin[r + 1]]])
                features.append(both)
                docs.append(np.full(len(both), j))
            f, d = np.concatenate(features), np.concatenate(docs)
            count = np.maximum(np.bincount(d, minlength=len(own)), 1)
            used, f = np.unique(f, return_inverse=True)
            share = np.bincount(f * len(own) + d, minlength=len(used) * len(own)).reshape(len(used), len(own)) / count
            hidden = share.T @ model.vectors[used]
            z = hidden @ model.output + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = np.eye(k)[label[own]] - p
            to_hidden, to_output = error @ model.output.T, hidden.T @ error / len(own)
            g = share @ to_hidden / len(own)
            squares[0][used] += g * g
            model.vectors[used] += rate * 0.2 * g / np.sqrt(squares[0][used])
            squares[1] += to_output**2
            model.output += rate * 0.2 * to_output / np.sqrt(squares[1])
    model.vectors = model.vectors.astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """The model from labelled documents that are not held out, per_class rows of each class at most."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IS NOT NULL").distinct()
    known = known.filter(bucket_of(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])
    return train(labelled_texts(docs, known, "quality", per_class))


def qualities(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    score is the probability of class 1: the share of the learned bias for null and empty texts, 1 if class 1
    alone could be learned, 0 if no label could. Rows whose labels disagree are learned with each; documents
    without a label and repeated rows are scored all the same. Every word of a text of any length is scored; a score on
    the threshold is class 1. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: list[float] = []
            for (texts,) in chunks([batch], columns=("text",)):
                out += own.probabilities(texts)[:, own.classes.index(1)].tolist() if own and 1 in own.classes else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(x >= threshold) for x in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (bucket_of(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
