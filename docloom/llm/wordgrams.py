"""Hashed character n-grams of many words at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Longer words are cut into pieces of so many characters.
PIECE = 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_pieces = re.compile(rf".{{1,{PIECE}}}", re.DOTALL)


def blank_words(text: str) -> list[str]:
    """Words between blanks; a word longer than PIECE is cut into pieces, so that all of it counts."""
    words = text.split()
    if words and max(map(len, words)) > PIECE:
        words = [p for w in words for p in (_pieces.findall(w) if len(w) > PIECE else (w,))]
    return words


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MUL
    return h ^ (h >> np.uint64(29))


def slabs(words: list[str], rows: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the words, their code points with < and > around, lengths), words of like length together."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    for at in range(0, len(words), rows):
        own = order[at : at + rows]
        wide = int(length[own[-1]])
        codes = np.full((len(own), wide + 2), 0, np.uint64)
        codes[:, 0] = 2
        if wide:
            codes[:, 1:-1] = np.array([words[i] for i in own], dtype=f"U{wide}").view(np.uint32).reshape(len(own), wide)
        codes[np.arange(len(own)), length[own] + 1] = 3
        yield own, codes, length[own] + 2


def grams(codes: np.ndarray, lengths: np.ndarray, low: int, high: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes below size, whether there) of the n-grams of each order from low to high."""
    h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64) + np.uint64(1)
    for n in range(1, high + 1):
        wide = codes.shape[1] - n + 1
        if wide < 1:
            return
        h = (h[:, :wide] + codes[:, n - 1 : n - 1 + wide]) * _MUL
        h ^= h >> np.uint64(32)
        if n >= low:
            yield (mixed(h + np.uint64(n)) % np.uint64(size)).astype(np.int64), np.arange(wide)[None, :] <= (lengths - n)[:, None]


def affixes(codes: np.ndarray, lengths: np.ndarray, most: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the prefixes and the suffixes of 1 to most characters, one column each."""
    rows, last = np.arange(len(codes)), codes.shape[1] - 1
    for k in range(1, most + 1):
        for side in (0, 1):
            h = np.full(len(codes), 11 + k * 2 + side, np.uint64)
            for i in range(1, k + 1):
                h = mixed(h + codes[rows, np.minimum(i, last) if side == 0 else np.maximum(lengths - 1 - i, 0)])
            yield (h % np.uint64(size)).astype(np.int64)[:, None], (lengths - 2 >= k)[:, None]


def weighed(words: list[str], columns: Callable, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights (rows of a table) of each word's features, and the number of its features.

    columns(codes, lengths) yields (indexes, whether there).
    """
    total, count = np.zeros((len(words), weights.shape[1])), np.zeros(len(words))
    padded = np.vstack([weights, np.zeros((1, weights.shape[1]), weights.dtype)])
    for own, codes, lengths in slabs(words):
        for index, there in columns(codes, lengths):
            total[own] += padded[np.where(there, index, len(weights))].sum(axis=1)
            count[own] += there.sum(axis=1)
    return total, count


def listed(words: list[str], columns: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of every feature of every word, sorted by word."""
    w, f = [], []
    for own, codes, lengths in slabs(words):
        for index, there in columns(codes, lengths):
            row, col = np.nonzero(there)
            w.append(own[row])
            f.append(index[row, col])
    if not w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, f = np.concatenate(w), np.concatenate(f)
    order = np.argsort(w, kind="stable")
    return w[order], f[order]


def numbered(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each word in turn, how many words each text has)."""
    seen: dict[str, int] = {}
    flat = [seen.setdefault(w, len(seen)) for words in texts for w in words]
    return list(seen), np.array(flat, np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


def spaced(words: list[str], most: int, run: int = 64) -> list[list[str]]:
    """Runs of consecutive words, evenly spaced over the text, of `most` words in all at most; for training only."""
    runs = [words[i : i + run] for i in range(0, len(words), run)]
    keep = max(1, most // run)
    return runs if len(runs) <= keep else [runs[i * len(runs) // keep] for i in range(keep)]
