"""Language ID by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, its character n-grams and its entry in a lexicon, all with
learned weights for each language; a table of transitions is learned with them. Forward-backward gives each
word its probability of each language; a document's language is the one with the largest mean probability,
and runs of words show code-switching (word_languages()). The chain is cut every RUN words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import wordgrams
from docloom.llm.common import bucket_of, chunks
from docloom.llm.sampling import sampled

UNKNOWN = "und"
RUN = 64
TABLE = 1 << 16
#: Training: rows of each language, words of a row, words of the lexicon, passes.
PER_LANGUAGE, ROW_WORDS, LEXICON, EPOCHS = 400, 640, 20_000, 3
HELD_OUT = (4, 2)
_word = re.compile(rf"[^\W\d_]{{1,{wordgrams.PIECE}}}")


def words_of(text: str | None) -> list[str]:
    return _word.findall(text.lower()) if text else []


def _columns(codes: np.ndarray, lengths: np.ndarray):
    yield from wordgrams.affixes(codes, lengths, 3, TABLE)
    yield from wordgrams.grams(codes, lengths, 2, 3, TABLE)


@dataclass
class Chain:
    """Weights of features (TABLE rows), of lexicon words, of transitions and of starts, for languages in order."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    known: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words, languages)."""
        total, count = wordgrams.weighed(words, _columns, self.weights)
        entry = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        return total / np.maximum(count, 1)[:, None] ** 0.5 + np.where(entry[:, None] >= 0, self.known[entry], 0.0)


def forward_backward(scores: np.ndarray, there: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities (T, B, K) of each word's label, expected transitions (K, K)) of B chains of T words at most.

    there: whether chain b has a word t; its words come first.
    """
    steps, n, k = scores.shape
    psi = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    a = psi[0] * np.exp(starts - starts.max())
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ step) * psi[t]
        alpha[t] = np.where(there[t][:, None], a / a.sum(axis=1, keepdims=True), alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        b = (psi[t + 1] * beta[t + 1]) @ step.T
        beta[t] = np.where(there[t + 1][:, None], b / b.sum(axis=1, keepdims=True), 1.0)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(1, steps):
        joint = alpha[t - 1][:, :, None] * step[None] * (psi[t] * beta[t])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint[there[t]].sum(axis=0)
    return p, pairs


def _chains(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) places of the words in `numbers`, and whether there: texts cut every RUN words."""
    begin = np.cumsum(sizes) - sizes
    runs = -(-sizes // RUN)
    owner = np.repeat(np.arange(len(sizes)), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = begin[owner] + nth * RUN
    size = np.minimum(RUN, sizes[owner] - nth * RUN)
    t = np.arange(int(size.max(initial=0)))[:, None]
    return np.minimum(at[None] + t, max(len(numbers) - 1, 0)), t < size[None]


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, batch: int = 256, seed: int = 3) -> Chain | None:
    """The chain from (text, language) rows; None without a language.

    Runs of different rows are joined at random places, so that transitions between languages are seen.
    """
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    k, rng, number = len(languages), np.random.default_rng(seed), {x: i for i, x in enumerate(languages)}
    runs = [(run, number[lang]) for text, lang in rows for run in wordgrams.spaced(words_of(text), ROW_WORDS) if run]
    counts: dict[str, Counter] = defaultdict(Counter)
    for run, y in runs:
        for w in run:
            counts[w][y] += 1
    frequent = sorted(counts, key=lambda w: (-counts[w].total(), w))[:LEXICON]
    chain = Chain(languages, np.zeros((TABLE, k)), {w: i for i, w in enumerate(frequent) if counts[w].total() > 1}, np.zeros((max(1, len(frequent)), k)), np.zeros((k, k)), np.zeros(k))
    words, flat, sizes = wordgrams.numbered([r for r, _ in runs])
    of_word, feature = wordgrams.listed(words, _columns)
    n_features = np.maximum(np.bincount(of_word, minlength=len(words)), 1)
    bounds = np.searchsorted(of_word, np.arange(len(words) + 1))
    entry = np.fromiter((chain.lexicon.get(w, -1) for w in words), np.int64, len(words))
    begin = np.cumsum(sizes) - sizes
    squares = {key: np.full_like(getattr(chain, key), 1e-2) for key in ("weights", "known", "moves", "starts")}
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            numbers, labels = np.zeros((RUN, len(own)), np.int64), np.zeros((RUN, len(own)), np.int64)
            size = sizes[own].copy()
            for j, r in enumerate(own):
                numbers[: sizes[r], j], labels[: sizes[r], j] = flat[begin[r] : begin[r] + sizes[r]], runs[r][1]
                if sizes[r] > 3 and rng.random() < 0.3:  # the rest comes from another run
                    o = int(rng.integers(len(runs)))
                    cut = int(rng.integers(1, sizes[r]))
                    more = min(int(sizes[o]), RUN - cut)
                    numbers[cut : cut + more, j], labels[cut : cut + more, j] = flat[begin[o] : begin[o] + more], runs[o][1]
                    size[j] = cut + more
            there = np.arange(RUN)[:, None] < size[None]
            distinct, which = np.unique(numbers[there], return_inverse=True)
            lengths = bounds[distinct + 1] - bounds[distinct]
            pick = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(bounds[distinct], lengths)
            owner = np.repeat(np.arange(len(distinct)), lengths)
            scale = n_features[distinct] ** -0.5
            emission = np.stack([np.bincount(owner, chain.weights[feature[pick], c], len(distinct)) for c in range(k)], axis=1) * scale[:, None]
            emission += np.where(entry[distinct][:, None] >= 0, chain.known[entry[distinct]], 0.0)
            scores = np.zeros((RUN, len(own), k))
            scores[there] = emission[which]
            p, pairs = forward_backward(scores, there, chain.moves, chain.starts)
            gold = np.eye(k)[labels]
            error = (gold - p)[there]
            by_word = np.stack([np.bincount(which, error[:, c], len(distinct)) for c in range(k)], axis=1)
            steps = {"weights": np.stack([np.bincount(feature[pick], (by_word[:, c] * scale)[owner], TABLE) for c in range(k)], axis=1)}
            in_lexicon = entry[distinct] >= 0
            steps["known"] = np.zeros_like(chain.known)
            steps["known"][entry[distinct][in_lexicon]] = by_word[in_lexicon]
            seen = np.zeros((k, k))
            np.add.at(seen, (labels[:-1][there[1:]], labels[1:][there[1:]]), 1)
            steps["moves"], steps["starts"] = seen - pairs, (gold[0] - p[0]).sum(axis=0)
            for key, g in steps.items():
                g = g / len(own)
                squares[key] += g * g
                table = getattr(chain, key)
                table += 0.3 * g / np.sqrt(squares[key])
    chain.weights = chain.weights.astype(np.float32)
    return chain


def _posteriors(chain: Chain, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, words in turn, words of each text, probabilities of the words in turn)."""
    words, flat, sizes = wordgrams.numbered([words_of(t) for t in texts])
    out = np.zeros((len(flat), len(chain.languages)), np.float32)
    if len(flat):
        emission = chain.emissions(words).astype(np.float32)
        places, there = _chains(flat, sizes)
        for at in range(0, places.shape[1], 4096):
            own, real = places[:, at : at + 4096], there[:, at : at + 4096]
            p = _marginals(np.where(real[:, :, None], emission[flat[own]], np.float32(0)), real, chain)
            out[own[real]] = p[real]
    return words, flat, sizes, out


def _marginals(scores: np.ndarray, there: np.ndarray, chain: Chain) -> np.ndarray:
    """The label probabilities of forward_backward(), without transitions, in single precision."""
    psi = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(chain.moves - chain.moves.max()).astype(np.float32)
    a = psi[0] * np.exp(chain.starts - chain.starts.max()).astype(np.float32)
    alpha = np.empty_like(psi)
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, len(psi)):
        a = (alpha[t - 1] @ step) * psi[t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t] = a
    b = np.ones_like(psi[0])
    for t in range(len(psi) - 2, -1, -1):
        b = (psi[t + 1] * b) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        b[~there[t + 1]] = 1
        alpha[t] *= b
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha


def predict(chain: Chain | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, mean probability) of each text; UNKNOWN and 0 where there is no letter or no model."""
    if chain is None:
        return [(UNKNOWN, 0.0)] * len(texts)
    words, flat, sizes, p = _posteriors(chain, texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    mean = np.stack([np.bincount(owner, p[:, c], len(texts)) for c in range(p.shape[1])], axis=1) / np.maximum(sizes, 1)[:, None]
    letters = np.array([any(map(str.isalpha, w)) for w in words], bool)
    has = np.bincount(owner[letters[flat]], minlength=len(texts)) > 0 if len(flat) else np.zeros(len(texts), bool)
    best = mean.argmax(axis=1)
    return [(chain.languages[b], float(min(1.0, mean[i, b]))) if has[i] else (UNKNOWN, 0.0) for i, b in enumerate(best)]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Chain | None:
    """The chain from text and non-null lang of documents that are not held out, per_language rows of each language at most."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]))
    found = sampled(rows.filter("text <> ''"), "lang", per_language).orderBy(F.xxhash64("doc_id"), "doc_id", "text", "lang").select("text", "lang")
    return train([(r["text"], r["lang"]) for r in found.collect()])


def languages(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, and so is everything where no language could
    be learned. Every word of a text of any length is labelled; of languages that tie the first by name is taken. lang
    may be null; other columns are ignored, whatever their names; repeated rows give a row each, alike; an empty table
    gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain or fit(docs))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for (texts,) in chunks([batch], columns=("text",)) for r in predict(model.value, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (bucket_of(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "text")
    return rows.mapInArrow(label, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def word_languages(chain: Chain, text: str | None) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of a text, for code-switched text."""
    words, flat, _, p = _posteriors(chain, [text])
    return [(words[w], chain.languages[int(row.argmax())], float(row.max())) for w, row in zip(flat, p, strict=True)]


def recognised_rows(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Documents whose language is not `und`, with all their columns; several languages in one text are no reason to drop it.

    Null texts and texts without a letter go; texts of any length are read whole; repeated rows all stay or all go, rows
    with a null doc_id too; columns keep their names and values; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain or fit(docs))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            found = [r for (part,) in chunks([texts], columns=("text",)) for r in predict(model.value, part)]
            yield batch.filter(pa.array([lang != UNKNOWN for lang, _ in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
