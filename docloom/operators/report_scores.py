"""How well a report record fits a question: words in common, and evidence for what the question says of totals, shares, languages, directions and replies.

What a question says is read once, on the driver; what a record says are array columns. Each kind of evidence is a
column of its own, so that one can be looked at alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import tokens as tk

#: Words by what they say of a question or a heading.
TO = ("को", "ko", "to", "bheje", "भेजे", "issued", "sent")
FROM = ("से", "se", "from", "प्राप्त", "prapt", "receive", "received", "aaye", "aye")
RECEIPT = ("प्राप्त", "prapt", "receive", "received", "aaye", "aye")
DISPATCH = ("send", "sent", "issue", "issued")
REPLY = ("उत्तर", "uttar", "जवाब", "jawab", "reply", "replies", "replied", "answer", "answers", "answered", "response", "responses")
TOTAL = ("कुल", "total", "kul", "टोटल")
PERCENT = ("प्रतिशत", "percent", "percentage", "pratishat")
LANGUAGES = {"hindi": ("hindi", "हिंदी", "हिन्दी"), "english": ("english", "अंग्रेजी", "अंग्रेज़ी")}
NOT, NEEDED = ("नहीं", "नही", "not", "no"), ("अपेक्षित", "आवश्यक", "required", "expected", "need")
#: A question for replies that were not needed names a reply and one of these, this many characters apart at most.
UNNEEDED, UNNEEDED_REPLY, UNNEEDED_APART = "not|required|requirement|need|expected|no|nhi|nahi|नहीं|नही|अपेक्षित|आवश्यक", "reply|replies|answer|answers|उत्तर|जवाब|uttar|jawab", 64
COUNTS = r"(?<![\wऀ-ॿ])(?:how\s+many|number\s+of|count|कितने|कितनी|कितना|संख्या|kul|kitne|kitni|kitna)(?![\wऀ-ॿ])"
#: How far a language may stand from the word that it belongs to, and weights of evidence.
REACH = 5
LABEL, CONTEXT, SECTION, BOTH_TOTAL = 2.0, 0.5, 2.5, 1.5
SHARE, NO_SHARE, SHARE_FOR_COUNT = 1.5, -1.5, -20.0
SOURCE, UNANSWERED, RECEIVED, REPLIED, REPLY_LANGUAGE, DIRECTION = 7.0, 14.0, 10.0, 8.0, 8.0, 10.0
SAME_LANGUAGE, OTHER_LANGUAGE = 4.0, -10.0


def language_near(words: list[str], actions: tuple[str, ...]) -> str | None:
    """The language that stands nearest to one of the action words, after it before before it."""
    own = {w: name for name, names in LANGUAGES.items() for w in names}
    near = [(abs(i - j), int(i < j), i, own[w]) for i, w in enumerate(words) if w in own for j, v in enumerate(words) if v in actions and abs(i - j) <= REACH]
    return min(near)[3] if near else None


def language_near_column(words: Column, actions: tuple[str, ...]) -> Column:
    """language_near() of an array of words."""
    places = F.sequence(F.lit(0), F.size(words) - 1)
    language = lambda w: reduce(lambda c, x: c.when(w.isin(*x[1]), x[0]), LANGUAGES.items(), F.when(F.lit(False), ""))
    languages = F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), language(words[i]).alias("l"))), lambda x: x["l"].isNotNull())
    acts = F.filter(places, lambda j: words[j].isin(*actions))
    pairs = F.flatten(F.transform(languages, lambda x: F.transform(acts, lambda j: F.struct(F.abs(x["i"] - j).alias("d"), (x["i"] < j).cast("int").alias("s"), x["i"].alias("i"), x["l"].alias("l")))))
    return F.when(F.size(words) > 0, F.array_min(F.filter(pairs, lambda p: p["d"] <= REACH))["l"])


@dataclass(frozen=True)
class Asked:
    """What a question says."""

    words: frozenset[str]
    share: bool
    count: bool
    total: bool
    languages: tuple[str, ...]
    sent: bool
    received: bool
    receipt: bool
    reply: bool
    unneeded: bool
    source: str | None
    reply_language: str | None


def asked(question: str) -> Asked:
    listed = tk.query_tokens(question)
    words = frozenset(listed)
    has = lambda names: not words.isdisjoint(names)
    share = has(PERCENT) or "%" in question
    low = question.lower()
    unneeded = bool(re.search(rf"(?:{UNNEEDED_REPLY}).{{0,{UNNEEDED_APART}}}(?:{UNNEEDED})|(?:{UNNEEDED}).{{0,{UNNEEDED_APART}}}(?:{UNNEEDED_REPLY})", low))
    dispatch, reply = has(TO) or has(DISPATCH), has(REPLY)
    return Asked(
        words, share, not share and bool(re.search(COUNTS, low)), has(TOTAL), tuple(n for n, names in LANGUAGES.items() if has(names)), has(TO) or "send" in words, has(FROM),
        has(RECEIPT) and not dispatch and not reply and not unneeded, reply, unneeded, None if dispatch else language_near(listed, FROM), language_near(listed, REPLY),
    )


def evidence(a: Asked, metric: Column, section: Column, region_header: Column, is_percent: Column) -> dict[str, Column]:
    """What a record adds to or takes from its score, by kind; kinds that the question says nothing of are left out."""
    empty = F.lit("")
    label, head = tk.tokens(F.coalesce(metric, empty)), tk.tokens(F.coalesce(section, empty))
    context = tk.tokens(F.concat_ws(" ", F.coalesce(section, empty), F.coalesce(region_header, empty)))
    has = lambda words, names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    either = lambda hit, yes, no=0.0: F.when(hit, yes).otherwise(no)
    spoken = {name: has(label, names) for name, names in LANGUAGES.items()}
    replies, idle = has(label, REPLY), has(label, NOT) & has(label, NEEDED)
    out = {"share": either(F.coalesce(is_percent, F.lit(False)), SHARE if a.share else SHARE_FOR_COUNT if a.count else NO_SHARE)}
    if a.total:
        out["total"] = either(has(label, TOTAL), BOTH_TOTAL)
    if a.source:
        out["source"] = either(language_near_column(head, FROM).eqNullSafe(F.lit(a.source)), SOURCE, -SOURCE)
    if a.unneeded:
        out["unneeded"] = either(idle, UNANSWERED, -UNANSWERED)
    if a.receipt:
        out["receipt"] = F.when(has(label, RECEIPT), RECEIVED).when(replies, -RECEIVED).otherwise(0.0)
    if a.reply:
        out["reply"] = either(replies & idle if a.unneeded else replies, REPLIED, -REPLIED)
    if a.reply and a.reply_language:
        out["language"] = either(spoken[a.reply_language], REPLY_LANGUAGE, -REPLY_LANGUAGE)
    elif len(a.languages) > 1:
        named = reduce(Column.__or__, spoken.values())
        out["language"] = either(named | has(label, TOTAL) if a.total else named, SAME_LANGUAGE, OTHER_LANGUAGE)
    elif a.languages:
        (own,) = a.languages
        out["language"] = either(spoken[own] | has(context, LANGUAGES[own]), SAME_LANGUAGE, OTHER_LANGUAGE)
    if a.sent or a.received:
        there, back = (TO, FROM) if a.sent else (FROM, TO)
        out["direction"] = either(has(context, there), DIRECTION) - either(has(context, back), DIRECTION)
    return out


def record_score(question: str, words: list[str], metric: Column, section: Column, region_header: Column, is_percent: Column) -> Column:
    """The score of a record for a question whose content words are given."""
    if not words:
        return F.lit(0.0)
    of = lambda c: tk.tokens(F.coalesce(c, F.lit("")))
    context = tk.tokens(F.concat_ws(" ", F.coalesce(section, F.lit("")), F.coalesce(region_header, F.lit(""))))
    common = LABEL * tk.stem_overlap(words, of(metric)) + CONTEXT * tk.stem_overlap(words, context) + SECTION * tk.stem_overlap(words, of(section))
    return reduce(Column.__add__, evidence(asked(question), metric, section, region_header, is_percent).values(), common)
