"""Tokens, term weights and lexical scores as column expressions."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits, underscore and the Devanagari block (whose vowel signs are not letters in regex classes).
TOKEN = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"
RUNS = r"[a-z0-9]+|[\x{0900}-\x{097F}]+"
_token = re.compile("[\\wऀ-ॿ]+")


def tokens(text: Column) -> Column:
    """Lower-cased tokens in turn."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def script_runs(text: Column) -> Column:
    """Runs of Latin letters and digits, or of Devanagari."""
    return F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """tokens() of a question, on the driver."""
    return _token.findall(text.lower())


def clean(text: Column) -> Column:
    """Punctuation to blanks, blanks squeezed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\x{0900}-\x{097F}]+", " "), " +", " "))


def sublinear(tf: Column) -> Column:
    """1 + ln(tf), to 4 places."""
    return F.round(1 + F.log(tf.cast("double")), 4)


def query_weights(text: str) -> dict[str, float]:
    """Sublinear weights of a question's tokens."""
    return {t: round(1 + math.log(n), 4) for t, n in Counter(query_tokens(text)).items()}


def tf(token_column: Column, term: str) -> Column:
    return F.size(F.filter(token_column, lambda t: t == term))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping substring count."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def lexical_score(text: Column, terms: list[str]) -> Column:
    """Sum of (1 + ln count) * sqrt(length of the term) over the terms that occur, to 4 places."""
    low = F.lower(text)
    parts = [F.when((n := occurrences(low, t.lower())) > 0, (1 + F.log(n.cast("double"))) * math.sqrt(len(t))).otherwise(0.0) for t in terms if t]
    return F.round(sum(parts, F.lit(0.0)), 4)


def search_terms(text: Column, most: int = 12) -> Column:
    """Clauses N(M), numbers, then words of 3 or more characters, each once in turn."""
    low = F.lower(text)
    clauses = F.regexp_extract_all(low, F.lit(r"[0-9]+\([0-9]+\)"), F.lit(0))
    numbers = F.regexp_extract_all(low, F.lit(r"[0-9]+"), F.lit(0))
    words = F.filter(tokens(text), lambda t: F.length(t) >= 3)
    return F.slice(F.array_distinct(F.concat(clauses, numbers, words)), 1, most)


def token_overlap(query: Column, candidate: Column) -> Column:
    """0.8 * recall + 0.2 * Jaccard of two token sets; 0 where either is empty."""
    q, c = F.array_distinct(query), F.array_distinct(candidate)
    both = F.size(F.array_intersect(q, c)).cast("double")
    return F.when((F.size(q) > 0) & (F.size(c) > 0), 0.8 * both / F.size(q) + 0.2 * both / F.size(F.array_union(q, c))).otherwise(0.0)


def stem_match(a: Column, b: Column) -> Column:
    """Equal, or the shorter (3 or more characters) begins the longer."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(short) >= 3) & F.startswith(long, short))


def stem_overlap(query: list[str], label: Column) -> Column:
    """How many query tokens match a token of the label by stem."""
    def hit(q: str) -> Column:
        return F.exists(label, lambda t: stem_match(F.lit(q), t)).cast("int")

    return sum(map(hit, query), F.lit(0))


def content_tokens(token_column: Column, stop: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Tokens without stop words, single characters and digits, with aliases replaced."""
    kept = F.filter(token_column, lambda t: (F.length(t) > 1) & ~t.isin(stop) & ~t.rlike("^[0-9]+$"))
    if not aliases:
        return kept
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.transform(kept, lambda t: F.coalesce(table[t], t))


def ngrams(token_column: Column, most: int | list[int]) -> Column:
    """All runs of 1 to `most` tokens, or of the numbers of tokens listed, joined by blanks."""
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(token_column) - n + 1)
        return F.when(F.size(token_column) >= n, F.transform(starts, lambda i: F.array_join(F.slice(token_column, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(runs, range(1, most + 1) if isinstance(most, int) else most))


def whitespace_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))
