"""Devanagari and Latin script functions: repair, romanisation, phonetic keys and fuzzy ratios."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The romanisation of Devanagari letters.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ळ": "l", "क़": "q", "ख़": "kh", "ग़": "g", "ज़": "z", "ड़": "r", "ढ़": "rh", "फ़": "f",
}
VOWELS = {"अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऑ": "o"}
SIGNS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॉ": "o", "ं": "n", "ँ": "n", "ः": "h"}
VIRAMA, NUKTA = "्", "़"
#: Roman spellings to letters, longest first.
TO_CONSONANT = {"chh": "छ", "ksh": "क्ष", "gya": "ज्ञ", "kh": "ख", "gh": "घ", "ch": "च", "jh": "झ", "th": "थ", "dh": "ध", "ph": "फ", "bh": "भ", "sh": "श",
                "k": "क", "g": "ग", "j": "ज", "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व", "s": "स", "h": "ह", "f": "फ", "z": "ज", "q": "क", "c": "क", "x": "क्स"}
TO_VOWEL = {"aa": ("आ", "ा"), "ee": ("ई", "ी"), "oo": ("ऊ", "ू"), "ai": ("ऐ", "ै"), "au": ("औ", "ौ"), "a": ("अ", ""), "i": ("इ", "ि"), "u": ("उ", "ु"), "e": ("ए", "े"), "o": ("ओ", "ो")}

DEVANAGARI = r"[\x{0900}-\x{097F}]"


def script_of(text: Column) -> Column:
    """mixed_hinglish, devanagari_hindi, latin_english_or_hinglish or neutral."""
    hindi, latin = text.rlike(DEVANAGARI), text.rlike("[A-Za-z]")
    return F.when(hindi & latin, "mixed_hinglish").when(hindi, "devanagari_hindi").when(latin, "latin_english_or_hinglish").otherwise("neutral")


def repair(text: Column, compose: bool = False, repairs: dict[str, str] | None = None) -> Column:
    """A blank between a consonant and its vowel sign goes, zero-width and private-use characters too; blanks are squeezed.

    compose applies NFKC first (in Arrow batches; the rest is built in). repairs are patterns and replacements of an
    OCR dictionary, which is data of a corpus and none by default.
    """
    text = nfkc(text) if compose else text
    for pattern, by in (repairs or {}).items():
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(text, r"[\x{200B}-\x{200D}\x{FEFF}\x{E000}-\x{F8FF}]", "")
    text = F.regexp_replace(text, r"([\x{0915}-\x{0939}]) +([\x{093E}-\x{094D}])", "$1$2")
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def romanize_text(text: str | None) -> str:
    """Consonant, vowel sign and inherent a to Roman letters; other characters but [a-z0-9] become single blanks."""
    t = unicodedata.normalize("NFC", text or "")
    out, i = [], 0
    while i < len(t):
        two = t[i : i + 2]
        key = two if two in CONSONANTS else t[i]
        if key in CONSONANTS:
            i += len(key)
            if i < len(t) and t[i] == NUKTA:
                i += 1
            out.append(CONSONANTS[key])
            if i < len(t) and t[i] == VIRAMA:
                i += 1
            elif i < len(t) and t[i] in SIGNS and t[i] not in "ंँः":
                out.append(SIGNS[t[i]])
                i += 1
            else:
                out.append("a")
            continue
        out.append(VOWELS.get(key) or SIGNS.get(key) or key)
        i += 1
    return re.sub("[^a-z0-9]+", " ", "".join(out).lower()).strip()


def devanagarize_text(text: str | None) -> str:
    """Greedy Roman to Devanagari: consonants of 3, 2 or 1 letters, vowels of 2 or 1; an initial vowel is independent."""
    out, t, i, open_ = [], (text or "").lower(), 0, False
    while i < len(t):
        for n in (3, 2, 1):
            if t[i : i + n] in TO_CONSONANT and len(t[i : i + n]) == n:
                if open_:
                    out.append(VIRAMA)
                out.append(TO_CONSONANT[t[i : i + n]])
                open_, i = True, i + n
                break
            if n < 3 and t[i : i + n] in TO_VOWEL and len(t[i : i + n]) == n:
                whole, sign = TO_VOWEL[t[i : i + n]]
                out.append(sign if open_ else whole)
                open_, i = False, i + n
                break
        else:
            out.append(t[i])
            open_, i = False, i + 1
    return "".join(out)


def seq_ratio_text(a: str | None, b: str | None) -> float:
    """2M / T of the matching blocks; 0 where either is null."""
    return 0.0 if a is None or b is None else SequenceMatcher(None, a, b).ratio()


def phonetic_text(word: str) -> str:
    """A reduced spelling: ph f, w v, z j, sh s, oo u, ee i, double letters single, without a final vowel."""
    for a, b in (("ph", "f"), ("w", "v"), ("z", "j"), ("sh", "s"), ("oo", "u"), ("ee", "i")):
        word = word.replace(a, b)
    return re.sub(r"[aeiou]+$", "", re.sub(r"(.)\1+", r"\1", word))


def phonetic(word: Column) -> Column:
    """phonetic_text() in built-in functions."""
    for a, b in (("ph", "f"), ("w", "v"), ("z", "j"), ("sh", "s"), ("oo", "u"), ("ee", "i")):
        word = F.replace(word, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(word, r"(.)\1+", "$1"), r"[aeiou]+$", "")


def skeleton(word: Column) -> Column:
    """Consonants alone, doubles single."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), "[^bcdfghjklmnpqrstvwxyz]", ""), r"(.)\1+", "$1")


def spelled_key(word: Column) -> Column:
    """A key of how a title is spelled, with its vowels, without a final a."""
    word = F.lower(word)
    for a, b in (("tion", "shan"), ("ck", "k"), ("ce", "se"), ("ci", "si"), ("c(?!h)", "k"), ("n(?=[bp])", "m"), ("[^a-z0-9]+", ""), (r"(.)\1+", "$1"), ("a$", "")):
        word = F.regexp_replace(word, a, b)
    return word


def title_key(word: Column) -> Column:
    """spelled_key() without vowels."""
    return F.regexp_replace(F.regexp_replace(spelled_key(word), "[aeiou]", ""), r"(.)\1+", "$1")


def person_key_text(name: str | None) -> str:
    """The key of a person's name: romanised, each word without final a's, with one spelling of long vowels, w and v."""
    words = []
    for w in romanize_text(name).split():
        for a, b in (("aa", "a"), ("w", "v"), ("ee", "i"), ("oo", "u")):
            w = w.replace(a, b)
        words.append(re.sub(r"(.)\1+", r"\1", re.sub("a+$", "", w)) or w)
    return " ".join(words)


def same_person_text(a: str, b: str) -> bool:
    """Equal keys, or as many words and a ratio of 0.84."""
    return a == b or (len(a.split()) == len(b.split()) and seq_ratio_text(a, b) >= 0.84)


def title_score_text(query: str | None, title: str | None, aliases: list[str] | None = None) -> float:
    """1 for equal, 0.95 for containment over 40 % of the length or an alias, else the better of shared tokens and 0.92 * ratio."""
    q, t = romanize_text(query), romanize_text(title)
    if not q or not t:
        return 0.0
    if q == t:
        return 1.0
    short, long = sorted((q, t), key=len)
    if short in long and len(short) >= 0.4 * len(long):
        return 0.95
    if any(romanize_text(a) == q for a in aliases or ()):
        return 0.95
    a, b = set(q.split()), set(t.split())
    return max(len(a & b) / len(a | b), 0.92 * seq_ratio_text(q, t))


def segments_score_text(query: str | None, title: str | None) -> float:
    """title_score_text() of the title or of its best part between colons, dashes and bars."""
    parts = [p for p in re.split(r"\s*[:：|–—]\s*|\s-\s", title or "") if p.strip()]
    return max([title_score_text(query, title), *(title_score_text(query, p) for p in parts if len(parts) > 1 and len(p.split()) > 1)])


def spelled_similarity_text(a: str | None, b: str | None) -> float:
    """The mean, over the words of a, of the best ratio to a word of b, on Roman spellings; 0 where either has none."""
    q, t = romanize_text(a).split(), romanize_text(b).split()
    return sum(max(seq_ratio_text(x, y) for y in t) for x in q) / len(q) if q and t else 0.0


#: Words that say nothing of a title.
TITLE_STOP = frozenset("in on at and or to is this its the of a an ka ke ki me mein men par hai aur".split())


def skeleton_text(word: str) -> str:
    """skeleton() of one word."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[^bcdfghjklmnpqrstvwxyz]", "", word.lower()))


def article_score_text(query: str | None, title: str | None) -> float:
    """1 for equal texts or Roman forms, 0.95 where one holds the other (4 letters or more), else by shared consonant skeletons: 0.7 of the question's, 0.3 of the title's; 0 below 0.40."""
    plain = lambda t: re.sub(r"[^\wऀ-ॿ]+", " ", (t or "").lower()).strip()
    for a, b in ((plain(query), plain(title)), (romanize_text(query), romanize_text(title))):
        if a and a == b:
            return 1.0
        if len(a) >= 4 and b and (a in b or b in a):
            return 0.95
    bones = lambda t: {skeleton_text(w) for w in romanize_text(t).split() if w not in TITLE_STOP and len(w) > 2} - {""}
    q, t = bones(query), bones(title)
    both = len(q & t)
    if not both or (both < 2 and both / len(q) < 0.5):
        return 0.0
    score = 0.7 * both / len(q) + 0.3 * both / len(t)
    return score if score >= 0.40 else 0.0


def token_forms(text: str, terms: dict[str, str] | None = None) -> list[str]:
    """Tokens of a question, their Roman and phonetic forms, and their other names by a table of terms; each once."""
    own = re.findall("[\\wऀ-ॿ]+", text.lower())
    roman = romanize_text(text).split()
    return list(dict.fromkeys([*own, *roman, *map(phonetic_text, roman), *((terms or {})[t] for t in own if t in (terms or {}))]))


def clean_key(text: Column) -> Column:
    """A label without bullets, numbering and the colon at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*(?:[-•*▪]|\(?[0-9ivx]{1,4}[.)]|\([a-zA-Zक-ह]\))\s*", ""), r"\s*[:：]\s*$", ""))


def clean_value(text: Column) -> Column:
    """A value without a colon or dash before it, blanks squeezed; null where nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*[:：–—-]\s*", ""), r"\s+", " "))
    return F.when(bare != "", bare)


def generic_header(text: Column) -> Column:
    """Whether a header says nothing: blank, a number, `Column n`, serial number, or remarks."""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).rlike(r"^(?:|[0-9]+\.?|\([0-9]+\)|column [0-9]+|s\.? ?no\.?|sr\.? ?no\.?|serial(?: number)?|क्रम(?:ांक| सं\.?)?|remarks?|टिप्पणी)$")


def cross_script_match_text(a: str, b: str) -> bool:
    """Stems of one script, or Roman forms of 5 letters or more alike by 0.78 with lengths within 3."""
    short, long = sorted((a, b), key=len)
    if a == b or (len(short) >= 3 and long.startswith(short)):
        return True
    x, y = romanize_text(a), romanize_text(b)
    return min(len(x), len(y)) >= 5 and abs(len(x) - len(y)) <= 3 and seq_ratio_text(x, y) >= 0.78


def _mapped(kind: str, f: Callable) -> Callable[..., Column]:
    def apply(*columns: Column) -> Column:
        @F.pandas_udf(kind)
        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(f)

        @F.pandas_udf(kind)
        def two(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for a, b in batches:
                yield pd.Series([f(x, y) for x, y in zip(a, b, strict=True)])

        return (one if len(columns) == 1 else two)(*columns)

    return apply


#: Arrow-batched forms.
nfkc = _mapped("string", lambda t: None if t is None else unicodedata.normalize("NFKC", t))
romanize = _mapped("string", romanize_text)
devanagarize = _mapped("string", devanagarize_text)
person_key = _mapped("string", person_key_text)
seq_ratio = _mapped("double", seq_ratio_text)
title_score = _mapped("double", title_score_text)
segments_score = _mapped("double", segments_score_text)
article_score = _mapped("double", article_score_text)
spelled_similarity = _mapped("double", spelled_similarity_text)
same_person = _mapped("boolean", same_person_text)
cross_script_match = _mapped("boolean", cross_script_match_text)
